"""Small building blocks over Column: binding, stripping, word splitting, first-match and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a regex class body that reads the same in every engine (Java's \s is ASCII only).
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same class for Java, which asks the ranges of a class one after the other: single characters up to 255 are one look into a table, and the
# rest is asked only within the range that holds it all.
WS = (
    r"[\x{09}\x{0a}\x{0b}\x{0c}\x{0d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
NOT_WS = f"[^{WS}]"
# White space that is not already one plain blank, so that most texts are left as they are.
UNEVEN = f" {WS}+|[{WS}&&[^ ]]{WS}*"
_SPACES = "".join(
    chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                        (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1)
)
LINE_BREAK = r"\r\n|[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column, chars: str = SPACE) -> Column:
    """Trim every character of a regex class body from both ends."""
    if isinstance(chars, str) and chars == SPACE:
        # Looks at the ends only; a pattern goes through the whole text, and through every run of blanks once per blank.
        return F.trim(col, F.lit(_SPACES))
    return F.regexp_replace(col, f"^[{chars}]+|[{chars}]+$", "")


def words(col: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(col, f"{WS}+"), lambda w: w != "")


def lines(col: Column) -> Column:
    """Lines without their breaks; a break at the very end adds no empty line."""
    return F.split(F.regexp_replace(col, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)


def texts(values: Sequence[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def has_any(lowered: Column, cues: Sequence[str]) -> Column:
    """True if any cue occurs in the text as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(c)) for c in cues])


def hits(lowered: Column, cues: Sequence[str]) -> Column:
    """How many of the cues occur in the text as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(c)).cast("int") for c in cues])


def first_match(lowered: Column, rules: Mapping[str, Sequence[str]], default: str | Column) -> Column:
    """Label of the first rule with a cue in the text."""

    def branches(t: Column) -> Column:
        out = F
        for label, cues in rules.items():
            out = out.when(has_any(t, cues), F.lit(label))
        return out.otherwise(F.lit(default) if isinstance(default, str) else default)

    return let(lowered, branches)


def best_label(lowered: Column, rules: Mapping[str, Sequence[str]], default: str | Column, score=hits) -> Column:
    """Label whose cues score highest; the earlier label wins a tie, the default if no cue occurs.

    The text is lower-cased once and every cue is searched once, whatever the expression is nested in.
    """

    def pick(row: Column) -> Column:
        top = F.array_max(row)
        winner = F.element_at(texts(list(rules)), F.array_position(row, top).cast("int"))
        return F.when(top > 0, winner).otherwise(F.lit(default) if isinstance(default, str) else default)

    return let(lowered, lambda t: let(F.array(*[score(t, cues) for cues in rules.values()]), pick))


def lookup(key: Column, table: Mapping[str, str], default: str | Column | None = None) -> Column:
    """Value of a small literal table, or the default."""
    out = F
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v))
    if default is None:
        return out.otherwise(F.lit(None).cast("string"))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def fill(template: str, **values: Column | str) -> Column:
    """Template text with `{name}` replaced by columns; other braces are kept as they are."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        value = values[name]
        parts.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)
