"""Free text to option label: one Column expression per model family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published answer patterns. The scripts that defined them
# match at the start of the text, hence \A; (?d) makes "." stop at "\n" only
# and (?U) makes \s and \b follow Unicode.
_ANSWER = r"""\{\s*(?:"explanation"\s*:\s*".*?"\s*,\s*)?"answer"\s*:\s*["']*([A-Z])["'.]*"""
STANDARD = r"(?dU)\A(?:(?:`*json\s*)*" + _ANSWER + r"""|["']*([A-Z])["'.]*)"""
QUOTED_FENCE = r"""(?dU)\A(?:(?:["'`]*json\s*)*""" + _ANSWER + r"""|["']*([A-Z])["'.]*)"""
END_ANCHORED = (
    r"""(?dmU)\A(?:(?:`*json\s*)?\{\s*"answer"\s*:\s*["']*([A-Z])["']*\s*\}*|["']*([A-Z])["'.]*$)"""
)
FIRST_CAPITAL = r"(?U)\b([A-Z])\b"
JSON_BLOCK = r"(?s)\{.*\}"
ANSWER_BLOCK = r"""(?s)\{.*?['"]answer['"].*?\}"""
THINK_END = "</think>"


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _label(text: Column, pattern: str) -> Column:
    text = strip(text)
    json_label = F.regexp_extract(text, pattern, 1)
    return F.when(json_label != "", json_label).otherwise(F.regexp_extract(text, pattern, 2))


def standard(text: Column) -> Column:
    """JSON answer object, else a leading capital letter, else empty."""
    return _label(text, STANDARD)


def quoted_fence(text: Column) -> Column:
    """As :func:`standard`, with quotes allowed in the code fence."""
    return _label(text, QUOTED_FENCE)


def think(text: Column) -> Column:
    """Drop everything up to the first closing think tag, then parse."""
    at = F.locate(THINK_END, text)
    tail = F.substr(text, at + F.lit(len(THINK_END)))
    return quoted_fence(F.when(at > 0, tail).otherwise(text))


def end_anchored(text: Column) -> Column:
    """No explanation field; a bare letter must end its line."""
    return _label(text, END_ANCHORED)


def before_dot(text: Column) -> Column:
    """Text before the first full stop."""
    return strip(F.split_part(text, F.lit("."), F.lit(1)))


def first_capital(text: Column) -> Column:
    """First stand-alone capital letter, else the stripped text."""
    found = F.regexp_extract(text, FIRST_CAPITAL, 1)
    return F.coalesce(F.when(found != "", found).otherwise(strip(text)), F.lit(""))


def json_answer(text: Column) -> Column:
    """The ``answer`` field of the outermost braces, else the stripped text.

    Valid JSON without the field gives the empty string.
    """
    block = F.regexp_extract(text, JSON_BLOCK, 0)
    parsed = F.try_parse_json(F.when(block != "", block))
    answer = F.coalesce(F.try_variant_get(parsed, "$.answer", "string"), F.lit(""))
    return F.when(parsed.isNotNull(), strip(answer)).otherwise(strip(text))


def stored(text: Column) -> Column:
    """The label was extracted when the answer was written."""
    return text


# Model family -> parser.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "gemini": json_answer,
    "qwen_2_5_vl_hf": standard,
    "qwen_2_vl_hf": standard,
    "qwen_3_vl_hf": think,
    "openai_gpt": standard,
    "llava_next_video": quoted_fence,
    "llava_ov": standard,
    "internvl3": standard,
    "video_llava": end_anchored,
    "llava_video": quoted_fence,
    "arrowrl": standard,
    "perceptionlm": before_dot,
    "genfs": json_answer,
    "aria": standard,
    "videorefer": stored,
}
# Families whose stored label is scored instead of the text.
STORED_LABEL = ("gemini",)


def parse_answer(
    text: Column, model_key: str | Column, extra: dict[str, Callable[[Column], Column]] | None = None
) -> Column:
    """Label for ``text`` by model family; ``extra`` adds or replaces families.

    With a Column key, tables that mix models are parsed in one pass.
    """
    parsers = {**PARSERS, **(extra or {})}
    if isinstance(model_key, str):
        return parsers[model_key](text)
    groups: dict[Callable[[Column], Column], list[str]] = {}
    for key, parser in parsers.items():
        groups.setdefault(parser, []).append(key)
    chain = None
    for parser, keys in groups.items():
        test = model_key.isin(keys)
        chain = F.when(test, parser(text)) if chain is None else chain.when(test, parser(text))
    unknown = F.raise_error(F.concat(F.lit("no parser for model "), model_key))
    return chain.otherwise(unknown.cast("string"))


def scored_label(text: Column, stored_label: Column, model_key: Column) -> Column:
    """The label the scorer uses: stored for some families, parsed for the rest."""
    return F.when(model_key.isin(*STORED_LABEL), stored_label).otherwise(
        parse_answer(text, model_key)
    )


def json_object_with_answer(text: Column) -> Column:
    """The first JSON block that names ``answer``, trailing commas removed.

    Text without such a block, or with a broken one, is an error.
    """
    block = F.regexp_extract(text, ANSWER_BLOCK, 0)
    tidy = F.regexp_replace(block, r",\s*([\]}])", "$1")
    missing = F.raise_error(F.concat(F.lit("no JSON answer object in: "), text)).cast("string")
    return F.when(F.try_parse_json(tidy).isNotNull(), tidy).otherwise(missing)
