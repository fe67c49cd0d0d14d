"""Option labels, option phrases and question text as Column expressions.

An answer is ``array<array<string>>`` with a kind: ``str`` is ``[["3"]]``,
``list`` is ``[["3", "4"]]`` and ``listoflist`` is ``[["3", "4"], ["5", "6"]]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, label styles and the wording of options.
ALPHABETS = {
    "digit": "0123456789",
    "alpha_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alpha_lower": "abcdefghijklmnopqrstuvwxyz",
}
LABEL_STYLES = {
    "dot": ("", "."),
    "single_parent": ("", ")"),
    "double_parent": ("(", ")"),
    "single_square": ("", "]"),
    "double_square": ("[", "]"),
}
NONE_TEXT = {1: "None of the options are correct", 2: "None of the above"}
ABSTAIN_TEXT = {1: "Not sure", 2: "Can't tell"}
POSITIONAL = ("left", "right", "front", "back", "rear")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and referred to by name.

    Column expressions are trees: a value that is used in many places would be
    copied, planned and evaluated in each of them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def label(idx: Column, alphabet: str = "alpha_upper") -> Column:
    """Option label of a 0-based index."""
    return F.substr(F.lit(ALPHABETS[alphabet]), idx + 1, F.lit(1))


def sheet_label(idx: Column) -> Column:
    """Spreadsheet-style letters: A, ..., Z, AA, AB, ..."""
    start = F.struct((idx + 1).cast("long").alias("rest"), F.lit("").alias("text"))

    def step(acc, _):
        digit = F.substr(F.lit(ALPHABETS["alpha_upper"]), ((acc["rest"] - 1) % 26 + 1).cast("int"), F.lit(1))
        return F.when(acc["rest"] <= 0, acc).otherwise(
            F.struct(F.floor((acc["rest"] - 1) / 26).alias("rest"), F.concat(digit, acc["text"]).alias("text"))
        )

    # 14 letters cover every long
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["text"])


def adorn(text: Column, style: str = "dot") -> Column:
    before, after = LABEL_STYLES[style]
    return F.concat(F.lit(before), text, F.lit(after))


def unadorn(text: Column, style: str = "dot") -> Column:
    before, after = LABEL_STYLES[style]
    return F.substr(text, F.lit(1 + len(before)), F.length(text) - len(before) - len(after))


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def erase_positional(text: Column) -> Column:
    """A role without its positional words."""
    return squeeze(F.regexp_replace(text, rf"(?U)\b(?:{'|'.join(POSITIONAL)})\b\s*", ""))


def single_phrase(answer: Column, kind: Column, mode: Column, tracking: Column, noun: str = "Part") -> Column:
    """Text of an option that names one answer."""
    first = F.get(answer, F.lit(0))
    name = F.concat_ws(" ", F.lit(noun), F.get(first, F.lit(0)))
    simple = F.when(mode == 3, F.concat(F.lit("Only "), name, F.lit(" is correct"))).when(
        mode == 2, F.concat(F.lit("Only "), name)
    ).otherwise(name)
    named = F.transform(first, lambda p: F.concat(F.lit(f"{noun} "), p))
    head = F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0)))
    listed = F.when(mode == 2, F.array_join(named, ", ")).otherwise(
        F.concat(F.array_join(head, ", "), F.lit(" and "), F.element_at(named, -1))
    )
    edges = F.array_join(
        F.transform(
            answer,
            lambda e: F.concat(
                F.lit(f"{noun} "), F.get(e, F.lit(0)), F.lit(f" and {noun} "), F.get(e, F.lit(1))
            ),
        ),
        ", ",
    )
    last = F.size(answer) - 1
    matches = F.array_join(
        F.transform(
            answer,
            lambda e, i: F.concat(
                F.when((i == last) & (last > 0), F.lit(" and ")).otherwise(F.lit("")),
                F.lit(f"{noun} "), F.get(e, F.lit(0)), F.lit(f" in Image A matches {noun} "),
                F.get(e, F.lit(1)), F.lit(" in Image B"),
                F.when(i < last, F.lit(", ")).otherwise(F.lit("")),
            ),
        ),
        "",
    )
    return squeeze(
        F.when(tracking, matches).when(kind == "str", simple).when(kind == "list", listed).otherwise(edges)
    )


def several_phrase(names: Column, noun: Column, mode: int = 1) -> Column:
    """Text of an option that says two or more named options are all correct."""
    one = F.transform(names, lambda n: F.concat_ws(" ", noun, n))
    count = F.size(names)
    head = lambda items: F.array_join(F.slice(items, 1, F.greatest(count - 1, F.lit(0))), ", ")
    if mode == 1:
        both = F.concat(F.lit("Both "), F.get(one, F.lit(0)), F.lit(" and "), F.get(one, F.lit(1)), F.lit(" are correct"))
        every = F.concat(F.lit("All of "), head(one), F.lit(" and "), F.element_at(one, -1), F.lit(" and are correct"))
    elif mode == 2:
        both = F.concat(F.lit("Both of "), F.lower(noun), F.lit("s "), F.array_join(names, " and "), F.lit(" are correct"))
        every = F.concat(F.lit("All of "), noun, F.lit("s "), head(names), F.lit(" and "), F.element_at(names, -1), F.lit(" are correct"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return squeeze(F.when(count == 2, both).otherwise(every))


def raw_json(answer: Column, kind: Column) -> Column:
    """Canonical JSON of an answer."""
    quoted = lambda part: F.concat(
        F.lit("["), F.array_join(F.transform(part, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", "), F.lit("]")
    )
    first = F.get(answer, F.lit(0))
    return (
        F.when(kind == "str", F.concat(F.lit('"'), F.get(first, F.lit(0)), F.lit('"')))
        .when(kind == "list", quoted(first))
        .otherwise(F.concat(F.lit("["), F.array_join(F.transform(answer, quoted), ", "), F.lit("]")))
    )


def quoted_answer(answer: Column, kind: Column) -> Column:
    """An answer as it is quoted inside a "both" or "all" option."""
    first = F.get(answer, F.lit(0))
    listed = F.concat(F.lit("['"), F.array_join(first, "', '"), F.lit("']"))
    return F.when(kind == "str", F.get(first, F.lit(0))).otherwise(listed)


def fill(template: Column, params: Column) -> Column:
    """Replace every ``{name}`` of the template by its parameter."""
    return F.aggregate(
        F.map_entries(params),
        template,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def map_part_ids(text: Column, renamed, word: str = "Part", token: str = "{}") -> Column:
    """Rewrite the id of every ``Part <id>`` in one pass; ``renamed`` maps an id Column.

    The text is split around the digit runs first, so an id that was just
    written is never read again, and ``Part 1`` does not touch ``Part 10``.
    """
    pieces = F.split(text, rf"(?<=\b{word} )(?=\d)|(?<=\d)(?=\D)")

    def piece(p, i):
        is_id = p.rlike(r"^\d+$") & F.get(pieces, i - 1).endswith(f"{word} ") & (i > 0)
        return F.when(is_id, F.coalesce(renamed(p), p)).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def natural_key(name: Column) -> Column:
    """Sort key that orders digit runs as numbers and ignores case: ``a2`` before ``A10``.

    An array that alternates text and padded numbers, text first.
    """
    tokens = F.split(name, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    keys = F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, 20, "0")).otherwise(F.lower(t)))
    return F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), keys)).otherwise(keys)


def time_mark(seconds: Column) -> Column:
    """``[mm:ss]``."""
    whole = F.floor(seconds)
    return F.format_string("[%02d:%02d]", F.floor(whole / 60), whole % 60)


def time_list(seconds: Column) -> Column:
    """``1.00s,2.50s`` for an array of times."""
    return F.array_join(F.transform(seconds, lambda t: F.format_string("%.2fs", t)), ",")


def fraction(text: Column) -> Column:
    """Value of ``a/b`` or ``a:b``; null for other text and for a zero denominator."""
    whole = F.regexp_replace(text, ":", "/")
    number = lambda i: F.regexp_extract(whole, r"^\s*(-?\d+)\s*/\s*(-?\d+)\s*$", i).try_cast("double")
    return F.try_divide(number(1), number(2))


def frame_rate(nominal: Column, average: Column, base: Column, default: float = 30.0) -> Column:
    """The nominal rate if given, else the first positive of average and base, else the default."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(nominal, positive(average), positive(base), F.lit(default))


def capped_stride(n: Column, prompts: Column, max_frames: int, wanted: int = 1) -> Column:
    """Frame-rate divisor that keeps prompts and frames within ``max_frames``."""
    needed = F.ceil((n - prompts) / (F.lit(max_frames) - prompts))
    return F.when(n > max_frames, F.greatest(needed, F.lit(wanted))).otherwise(F.lit(wanted))
