#: Words, white space, personal data and junk of several kinds, with copies, nulls and clashing columns.
BASE = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing quietly in the tall green trees today."
TEXTS = [
    BASE,
    BASE,
    BASE.replace("quietly", "loudly"),
    None,
    "",
    " \n\t ",
    "one two",
    "Write to a.b+c@mail.example.com or call +1 (555) 010-2233 now, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1.",
    "x" * 20_000,
    ("word%d " * 1 % 7) + " ".join(f"w{i}" for i in range(8000)),
    "<|endoftext|> don't  stop\n\n naïve 日本語 👩‍👩‍👧 ²½ 　end\x85 <|endoftext|>",
    "aaaa " * 50,
    "ÀÉ ß A b\x0bc\x0cd\x1ce",
    "%%% ### ||| <<< &&& $$$ *** spam spam spam spam spam spam spam",
]
