"""Security indicators of scripts, links, file names and raw bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import weight
from .rules import Rule

# The words and patterns that the indicators look for.
SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf", ".cc", ".info", ".biz"]
SHORTENERS = ["bit.ly", "tinyurl", "t.co", "goo.gl", "ow.ly", "is.gd"]
SUSPICIOUS_PATHS = ["/download", "/exe", "/install", "/setup", "/update"]
DATA_PARAMETERS = ["?data=", "&data=", "?info=", "&info=", "?user=", "&user="]
LINK_SCHEMES = ["ftp://", "file://", "javascript:", "data:"]
LINK_DOMAINS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd"]
LOCAL_ADDRESSES = ["..", "localhost", "127.0.0.1", "192.168.", "10."]
SCRIPT_WORDS = ["eval(", "document.write", "unescape(", "activexobject", "wscript.shell", "new array(", "fromcharcode", "shellcode", "exploit", "payload", "app.launchurl", "this.print", "app.execdialog"]
JAVASCRIPT_TEXTS = ["javascript", "eval(", "unescape(", "fromcharcode", "app.launchurl", "this.exportdataobject", "submitform"]
SUSPICIOUS_TEXTS = ["/openaction", "/aa", "/launch", "/uri", "/xfa", "cmd.exe", "powershell", "javascript:", "file://", "http://", "https://"]
PLAIN_EXTENSIONS = [".txt", ".pdf", ".doc", ".jpg", ".png", ".zip"]
EXECUTABLE_EXTENSIONS = [".exe", ".scr", ".bat", ".com", ".pif"]
PRODUCER_QUIRKS = {"Quirk:Adobe": ["adobe"], "Quirk:Apple": ["apple", "quartz", "mac os x"], "Quirk:MuPDF": ["mupdf"], "Quirk:Ghostscript": ["ghostscript"]}
ACTION_SEVERITY = {"Launch": "Critical", "URI": "Medium", "SubmitForm": "High", "ImportData": "High"}
MAGIC = {"ZIP": "504B0304", "ZIP_EOCD": "504B0506", "RAR": "526172211A0700", "7Z": "377ABCAF271C", "ELF": "7F454C46", "MZ": "4D5A", "OLE": "D0CF11E0A1B11AE1", "PNG": "89504E470D0A1A0A", "JPEG": "FFD8FF", "GIF87a": "474946383761", "GIF89a": "474946383961", "MP4": "66747970"}


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences, without a regular expression."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())).cast("long")


def suspicious_url(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike("https?://[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}") | contains_any(low, SUSPICIOUS_TLDS + SHORTENERS + SUSPICIOUS_PATHS)


def risky_link(url: Column) -> Column:
    low = F.lower(url)
    scheme = reduce(lambda a, b: a | b, [low.startswith(s) for s in LINK_SCHEMES])
    return scheme | contains_any(low, LINK_DOMAINS + LOCAL_ADDRESSES) | (occurrences(low, ".") > 6)


def exfiltrating_url(url: Column) -> Column:
    """Data parameters, or a long link whose query is nothing but letters, digits, = and &."""
    low = F.lower(url)
    query = F.coalesce(F.get(F.split(url, "\\?"), 1), F.lit(""))
    return contains_any(low, DATA_PARAMETERS) | (low.contains("=") & (F.octet_length(url) > 100) & (F.octet_length(query) > 50) & query.rlike("^[A-Za-z0-9=&]*$"))


def obfuscated_script(script: Column) -> Column:
    """At least three of seven signs."""
    marks = F.length(F.regexp_replace(script, "[\\p{L}\\p{N}\\s]", ""))
    signs = [
        marks / F.octet_length(script) > 0.4,
        script.contains("var "),
        script.rlike("[a-zA-Z_$][a-zA-Z0-9_$]{20,}"),
        occurrences(script, "\\x") > 10,
        occurrences(script, "\\u") > 5,
        occurrences(script, " + ") > 20,
        script.contains("eval(") & (script.contains("unescape(") | script.contains("fromCharCode")),
    ]
    return (F.octet_length(script) > 0) & (reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signs]) >= 3)


def shellcode_script(script: Column) -> Column:
    patterns = ["\\\\x[0-9a-fA-F]{2}", "\\\\u[0-9a-fA-F]{4}", "String\\.fromCharCode", "unescape\\(", "eval\\("]
    found = reduce(lambda a, b: a + b, [script.rlike(p).cast("int") for p in patterns])
    return (F.regexp_count(script, F.lit(patterns[0])) > 50) & (found >= 2)


def heap_spray_script(script: Column) -> Column:
    array = script.contains("new Array(") & (script.contains("0x") | script.rlike("[0-9]{4,}"))
    return array & contains_any(script, ["for(", "while("]) & (hits(script, ["new Array(", ".length", "for(", "String("]) >= 3)


def double_extension(name: Column) -> Column:
    pattern = f"({'|'.join(PLAIN_EXTENSIONS)})({'|'.join(EXECUTABLE_EXTENSIONS)})$".replace(".", "\\.")
    return F.lower(name).rlike(pattern)


def hidden_executable(name: Column) -> Column:
    return F.lower(name).contains(" .exe") | name.contains("‮")


def url_rules(url: Column) -> list[Rule]:
    return [Rule("SUSPICIOUS_URL", "Medium", suspicious_url(url)), Rule("DATA_EXFILTRATION", "High", exfiltrating_url(url)), Rule("RISKY_LINK", "Low", risky_link(url))]


def script_rules(script: Column) -> list[Rule]:
    return [Rule("OBFUSCATED", "High", obfuscated_script(script)), Rule("SHELLCODE", "Critical", shellcode_script(script)), Rule("HEAP_SPRAY", "Critical", heap_spray_script(script)), Rule("SUSPICIOUS_WORDS", "Medium", contains_any(F.lower(script), SCRIPT_WORDS))]


def file_rules(name: Column) -> list[Rule]:
    return [Rule("DOUBLE_EXTENSION", "High", double_extension(name)), Rule("HIDDEN_EXECUTABLE", "Critical", hidden_executable(name))]


def text_rules(text: Column) -> list[Rule]:
    low = F.lower(text)
    return [Rule("JAVASCRIPT_TEXT", "Medium", contains_any(low, JAVASCRIPT_TEXTS)), Rule("SUSPICIOUS_TEXT", "Low", contains_any(low, SUSPICIOUS_TEXTS))]


def quirk_rules(producer: Column, creator: Column) -> list[Rule]:
    both = F.lower(F.concat_ws(" ", producer, creator))
    return [Rule(code, "Warning", contains_any(both, words)) for code, words in PRODUCER_QUIRKS.items()]


def correlated(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, code, severity) that follow from a subject's findings taken together."""
    first = found.groupBy(by).agg(
        F.count_if(F.col("severity").isin("Critical", "High")).alias("grave"),
        F.bool_or(F.col("code").isin("OBFUSCATED", "SHELLCODE", "HEAP_SPRAY", "SUSPICIOUS_WORDS")).alias("script"),
        F.bool_or(F.col("code").isin("SUSPICIOUS_URL", "DATA_EXFILTRATION", "RISKY_LINK")).alias("network"),
        F.bool_or(F.col("code").isin("DOUBLE_EXTENSION", "HIDDEN_EXECUTABLE")).alias("executable"),
    )
    rules = [Rule("MULTIPLE_GRAVE", "Critical", F.col("grave") > 2), Rule("SCRIPT_AND_NETWORK", "High", F.col("script") & F.col("network")), Rule("SCRIPT_AND_EXECUTABLE", "Critical", F.col("script") & F.col("executable"))]
    from .rules import findings

    return findings(first, rules, by)


def magic_hits(content: Column) -> Column:
    """Names of the file formats whose magic bytes lie anywhere in the binary."""
    hexed = F.hex(content)
    # a match must begin at a byte, which is an even place of the hex text
    even = lambda m: hexed.rlike(f"^(?:..)*?{m}")
    return F.array_compact(F.array(*[F.when(even(m), F.lit(name)) for name, m in MAGIC.items()]))


def trailing_bytes(text: Column, marker: str = "%%EOF") -> Column:
    """What follows the last end marker, without white space; null where there is no marker."""
    return F.when(text.contains(marker), F.regexp_replace(F.substring_index(text, marker, -1), "^[\\s\\x00]+", ""))


def sanitized(text: Column, forbidden: list[str], most: int) -> Column:
    """Forbidden patterns replaced, then cut at the greatest length."""
    for pattern in forbidden:
        text = F.regexp_replace(text, pattern, "[SANITIZED]")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("[TRUNCATED]"))).otherwise(text)


def truncated_evidence(text: Column) -> Column:
    return F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(197)), F.lit("..."))).otherwise(text)


def total_weight(found: DataFrame, by: str = "doc_id") -> DataFrame:
    return found.groupBy(by).agg(F.sum(weight(F.col("severity"))).alias("weight"))
