"""Sampled functions of several inputs and postfix calculators, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- sampled functions ---


def packed_samples(values: list[int], bits: int) -> bytes:
    """Samples of so many bits each, high bit first, the last byte filled with zeros."""
    whole = "".join(format(v, f"0{bits}b") for v in values)
    whole += "0" * (-len(whole) % 8)
    return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8))


def sample(samples: Column, place: Column, bits: int) -> Column:
    """The sample at a place, read from five bytes around it; ``bits`` is 32 at most."""
    first = place * bits
    window = F.rpad(F.hex(F.substring(samples, (F.floor(first / 8) + 1).cast("int"), F.lit(5))), 10, "0")
    return F.call_function("shiftright", F.conv(window, 16, 10).cast("long"), (40 - bits - first % 8).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def _scaled(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return F.lit(float(to_low)) + (x - low) * ((to_high - to_low) / (high - low) if high != low else 0.0)


def sampled(
    inputs: list[Column], samples: Column, sizes: list[int], bits: int, domain: list[tuple[float, float]],
    outputs: list[tuple[float, float]], encode: list[tuple[float, float]] | None = None, decode: list[tuple[float, float]] | None = None,
) -> list[Column]:
    """A function of bit-packed samples on a grid, linear between the 2 ** m corners of a cell.

    The first input's samples lie next to each other, and a grid point's outputs.  Inputs are held to
    the domain, encoded to places on the grid and held to it; outputs are decoded and held to their range.
    Absent encode is the whole grid, absent decode the range.
    """
    places = []
    for x, size, (low, high), to in zip(inputs, sizes, domain, encode or [(0, n - 1) for n in sizes]):
        held = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x.cast("double")))
        places.append(F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), _scaled(held, low, high, *to))))
    cells = [F.least(F.floor(p), F.lit(max(0, n - 2))) for p, n in zip(places, sizes)]
    strides = [reduce(lambda a, b: a * b, sizes[:k], 1) for k in range(len(sizes))]
    found = []
    for j, (low, high) in enumerate(outputs):
        total: Column = F.lit(0.0)
        for corner in product((0, 1), repeat=len(inputs)):
            if any(c and n == 1 for c, n in zip(corner, sizes)):
                continue
            weight, index = F.lit(1.0), F.lit(0).cast("long")
            for c, p, at, stride, n in zip(corner, places, cells, strides, sizes):
                weight = weight * ((p - at) if c else (1 - (p - at)))
                index = index + (at + c) * stride
            total = total + weight * sample(samples, index * len(outputs) + j, bits)
        value = _scaled(total, 0, (1 << bits) - 1, *(decode[j] if decode else (low, high)))
        found.append(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))
    return found


# --- calculators ---


class CalculatorError(ValueError):
    """A program that cannot run; the message begins with the error's name: stackunderflow, typecheck, rangecheck, undefined or syntaxerror."""


def _tree(program: str) -> list:
    """Words, and lists for what stands in braces."""
    stack: list[list] = [[]]
    for word in re.findall(r"[{}]|[^\s{}]+", program):
        if word == "{":
            stack.append([])
        elif word == "}":
            if len(stack) < 2:
                raise CalculatorError("syntaxerror: a brace too many")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(word)
    if len(stack) > 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise CalculatorError("syntaxerror: a program is one pair of braces")
    return stack[0][0]


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _whole(x: Column) -> Column:
    return x.cast("long")


#: Words by what they take: numbers give a number, or a truth value where they compare.
ONE: dict[str, Callable] = {
    "neg": lambda a: -a, "abs": F.abs, "sqrt": F.sqrt, "floor": lambda a: F.floor(a).cast("double"), "ceiling": lambda a: F.ceil(a).cast("double"), "round": _round, "truncate": _toward_zero,
    "cvi": _toward_zero, "cvr": lambda a: a, "ln": F.ln, "log": F.log10, "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)),
}
TWO: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide, "exp": F.pow,
    "idiv": lambda a, b: _toward_zero(F.try_divide(_toward_zero(a), _toward_zero(b))), "mod": lambda a, b: F.try_mod(_whole(a), _whole(b)).cast("double"),
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "bitshift": lambda a, b: F.when(b >= 0, F.call_function("shiftleft", _whole(a), b.cast("int"))).otherwise(F.call_function("shiftright", _whole(a), (-b).cast("int"))).cast("double"),
}
COMPARE: dict[str, Callable] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
LOGIC: dict[str, tuple[Callable, Callable]] = {
    "and": (lambda a, b: a & b, lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double")),
    "or": (lambda a, b: a | b, lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double")),
    "xor": (lambda a, b: a != b, lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double")),
}


class _Value:
    """A stack's entry: a column, whether it is a truth value, and its number where that is known while the plan is made."""

    def __init__(self, column: Column, truth: bool = False, number: float | None = None):
        self.column, self.truth, self.number = column, truth, number


class _Machine:
    def __init__(self, stack: list[_Value]):
        self.stack = stack

    def pop(self, truth: bool | None = None) -> _Value:
        if not self.stack:
            raise CalculatorError("stackunderflow: a word takes more than there is")
        value = self.stack.pop()
        if truth is not None and value.truth != truth:
            raise CalculatorError("typecheck: a truth value is not a number")
        return value

    def count(self) -> int:
        number = self.pop(False).number
        if number is None or number != int(number):
            raise CalculatorError("typecheck: a count must be a whole number that stands in the program")
        return int(number)

    def push(self, column: Column, truth: bool = False) -> None:
        self.stack.append(_Value(column, truth))

    def below(self, n: int) -> list[_Value]:
        if n < 0:
            raise CalculatorError("rangecheck: a count below zero")
        if n > len(self.stack):
            raise CalculatorError("stackunderflow: a word takes more than there is")
        return self.stack[len(self.stack) - n :]

    def run(self, words: list) -> None:
        waiting: list[list] = []
        for word in words:
            if isinstance(word, list):
                waiting.append(word)
                continue
            if word in ("if", "ifelse"):
                self.branch(waiting, word)
                waiting = []
                continue
            if waiting:
                raise CalculatorError("syntaxerror: braces belong to if or ifelse")
            self.word(word)
        if waiting:
            raise CalculatorError("syntaxerror: braces belong to if or ifelse")

    def branch(self, blocks: list[list], word: str) -> None:
        """Both branches run, each on the stack as it is; what they leave is merged place by place."""
        if len(blocks) != (1 if word == "if" else 2):
            raise CalculatorError(f"syntaxerror: {word} has {len(blocks)} pairs of braces before it")
        test = self.pop(True).column
        sides = []
        for block in (blocks + [[]])[:2]:
            side = _Machine(list(self.stack))
            side.run(block)
            sides.append(side.stack)
        if len(sides[0]) != len(sides[1]) or any(a.truth != b.truth for a, b in zip(*sides)):
            raise CalculatorError("rangecheck: branches leave stacks of different shape")
        self.stack = [a if a is b else _Value(F.when(test, a.column).otherwise(b.column), a.truth) for a, b in zip(*sides)]

    def word(self, word: str) -> None:
        if word in ONE:
            self.push(ONE[word](self.pop(False).column))
        elif word in TWO or word in COMPARE and not (len(self.stack) > 1 and self.stack[-1].truth):
            b, a = self.pop(False).column, self.pop(False).column
            self.push((TWO.get(word) or COMPARE[word])(a, b), word in COMPARE)
        elif word in COMPARE:
            b, a = self.pop(True).column, self.pop(True).column
            self.push(COMPARE[word](a, b), True)
        elif word in LOGIC:
            b, a = self.pop(), self.pop()
            if a.truth != b.truth:
                raise CalculatorError("typecheck: a truth value is not a number")
            self.push(LOGIC[word][not a.truth](a.column, b.column), a.truth)
        elif word == "not":
            a = self.pop()
            self.push(~a.column if a.truth else F.bitwise_not(_whole(a.column)).cast("double"), a.truth)
        elif word in ("true", "false"):
            self.push(F.lit(word == "true"), True)
        elif word == "pop":
            self.pop()
        elif word == "exch":
            self.stack += self.below(2)[::-1]
            del self.stack[-4:-2]
        elif word == "dup":
            self.stack += self.below(1)
        elif word == "copy":
            self.stack += self.below(self.count())
        elif word == "index":
            self.stack.append(self.below(n + 1)[0] if (n := self.count()) >= 0 else self.below(n)[0])
        elif word == "roll":
            by, n = self.count(), self.count()
            held = self.below(n)
            if n:
                self.stack[len(self.stack) - n :] = held[-by % n or n :] + held[: -by % n or n] if by % n else held
        else:
            try:
                number = float(word)
            except ValueError:
                raise CalculatorError(f"undefined: {word}") from None
            self.stack.append(_Value(F.lit(number), number=number))


def calculated(inputs: list[Column], program: str, outputs: list[tuple[float, float]] | None = None) -> list[Column]:
    """A postfix program in braces over the inputs, the first lowest; what it leaves, the lowest first, each held to its range where ranges are given.

    Division by zero and the like give null.  ``if`` and ``ifelse`` become conditions of the plan;
    counts of ``copy``, ``index`` and ``roll`` must be numbers of the program.
    """
    machine = _Machine([_Value(x.cast("double")) for x in inputs])
    machine.run(_tree(program))
    found = [v.column for v in machine.stack]
    if outputs is not None:
        if len(found) < len(outputs):
            raise CalculatorError("stackunderflow: fewer values than ranges")
        found = [F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), c)) for c, (a, b) in zip(found[len(found) - len(outputs) :], outputs)]
    return found
