"""Building and checking multiple-choice questions.

All randomness is a hash of (seed, question, answer): the same question gets the
same options on any number of executors and in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions import text
from markwise.functions.ids import question_path
from markwise.operators import graph

NONE, ABSTAIN = '"none"', '"abstain"'
PREPROMPT, OPTION_SEP = "\nOptions:\n", "\n"

# Category, template type, kind of option, question text.
TEMPLATES = (
    ("mating", "1part", "part", "Out of the given options, which part will {query_part} be directly connected to during the assembly video?"),
    ("mating", "2parts", "binary", "Are {query_part1} and {query_part2} connected in the fully-assembled furniture?"),
    ("mating", "2parts_frame_old", "binary", "Are {query_part1} and {query_part2} connected (physically in contact) in the shown image?"),
    ("mating", "2parts_frame", "binary", "In this task, \"connected\" means the two parts are in direct physical contact, in the same way they will be when the furniture is fully assembled (not merely near each other or partially aligned). Based on the given image, are {query_part1} and {query_part2} connected?"),
    ("mating", "find_edges", "edge", "Which of the parts shown in the highlighted image are directly connected in the fully-assembled furniture?"),
    ("temporal_loc", "1part_order", "part", "Which of the highlighted parts are connected (brought in direct physical contact) to {query_part} next starting from the assembly state shown in the image?"),
    ("temporal_loc", "1part_order_last", "part", "Which highlighted part is the last to connect (brought in direct physical contact) to {query_part} in the video?"),
    ("temporal_loc", "1edge_order", "edge", "Which highlighted pair of parts is connected first in the video?"),
    ("temporal_loc", "1edge_order_last", "edge", "Which highlighted pair of parts is connected last in the video?"),
    ("temporal_loc", "latest_change", "part", "Which labeled part was connected last to reach the current assembly state shown in the image?"),
    ("temporal_loc", "next_change", "part", "Which labeled part will be connected next to the current assembly state shown in the image?"),
    ("temporal_ord", "many_part_order", "part_list", "Which of the following options lists the highlighted parts in the exact order that they become directly attached (physically in contact) to {query_part} in the video, from the first attachment event to the last?"),
    ("temporal_ord", "edge_order", "edge_list", "Each option below lists a sequence of part connections. Which of these options gets the temporal ordering of the connections correct?"),
    ("tracking", "track_multi", "edge_list", "Identify the correct set of matches from Image A to Image B."),
    ("tracking", "track_single", "part", "Identify which part in Image B matches {query_part} in Image A."),
    ("correspondence", "sgc_1part", "part", "Out of the given options, which part will form the {semantic_role} of the fully-assembled furniture?"),
    ("correspondence", "sgc_1part_w_cat", "part", "Out of the given options, which part will form the {semantic_role} of the fully-assembled {category}?"),
)
# Temporal templates whose single options use the short phrase.
SHORT_PHRASE = ("1part_order", "1part_order_last", "latest_change", "next_change")
MOVED_TO_ORDER = ("edge_order", "many_part_order")


def _lookup(column: int) -> Column:
    pairs = [(f"{t[0]}/{t[1]}", t[column]) for t in TEMPLATES]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    key = F.concat_ws("/", "question_category", "template_type")
    unknown = F.raise_error(F.concat(F.lit("no template "), key)).cast("string")
    return F.coalesce(table[key], unknown)


def template_text() -> Column:
    return _lookup(3)


def option_kind() -> Column:
    return _lookup(2)


def _roll(seed: int, salt: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), *parts))


def _number(seed: int, salt: str, qid: Column, low: Column, high: Column) -> Column:
    """Integer of [low, high) by the question's hash."""
    value = F.conv(F.substring(_roll(seed, salt, qid), 1, 8), 16, 10).cast("long")
    return (low + value % F.greatest(high - low, F.lit(1))).cast("int")


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _option(raw: Column, words: Column, is_correct: Column, answers: Column) -> Column:
    return _named(raw_json=raw, text=words, is_correct=is_correct, answers=answers)


def _plain(code: str, words: str, is_correct: bool) -> Column:
    no_answers = F.expr("cast(array() as array<string>)")
    return _option(F.lit(code), F.lit(words), F.lit(is_correct), no_answers)


def _option_counts(q: Column, seed: int, randomize: bool) -> Column:
    """How many correct (kc) and wrong (kw) singles a question shows."""
    c, w, n, qid = F.size(q["c"]), F.size(q["w"]), q["n"], q["qid"]
    cap = F.least(w, n)
    few = F.when(cap > 2, _number(seed, "k0", qid, F.lit(2), cap)).otherwise(F.lit(2))
    if randomize:
        one_wrong = F.when(w > 1, _number(seed, "k1", qid, F.lit(1), cap)).otherwise(w)
        low, high = F.greatest(n - 2 - w, F.lit(0)), F.least(c, n)
        many = F.when(low == high, high).otherwise(_number(seed, "kc", qid, low, high))
    else:
        one_wrong, many = F.least(n - 1, w), F.least(c, n - 1)
    kc = F.when(q["binary"], F.lit(1)).when(c <= 1, c).otherwise(many)
    rest = lambda k: n - k - F.when(k != 1, 1).otherwise(0)
    kw = lambda k: (
        F.when(q["binary"], F.lit(1)).when(c == 0, few).when(c == 1, one_wrong)
        .otherwise(F.least(F.greatest(rest(k), F.lit(0)), w))
    )

    def checked(k: Column) -> Column:
        # with five or more options and no correct answer three slots could stay open
        fits = (c + w >= 2) & (k["kw"] <= w) & (k["kc"] + k["kw"] <= n) & (n - k["kc"] - k["kw"] <= 2)
        too_few = F.raise_error(F.concat(F.lit("answers do not fill the options of "), qid)).cast("int")
        return _named(kc=F.when(fits, k["kc"]).otherwise(too_few), kw=k["kw"])

    return text.let(kc, lambda k: text.let(_named(kc=k, kw=kw(k)), checked))


def assemble_options(
    df: DataFrame,
    n: int | Column = 4,
    seed: int = 42,
    add_abstain: bool = False,
    add_none_at_end: bool = True,
    randomize_options: bool = True,
    alphabet: str = "alpha_upper",
    label_style: str = "dot",
    preprompt: str = PREPROMPT,
    option_sep: str = OPTION_SEP,
    noun: str = "Part",
) -> DataFrame:
    """Labelled options from correct and incorrect candidates.

    Input: qid, question_category, template_type, kind (``str``, ``list`` or
    ``listoflist``), declared (``str`` or ``list``: the type singles should
    have), binary, raw_qstr, correct, incorrect (arrays of answers). Adds
    options, correct_option, num_options and qstr. Every row on its own, no shuffle.
    """
    n_col = F.lit(n) if isinstance(n, int) else n
    # An answer travels with its JSON: both are needed for hashing and for the option.
    coded = lambda answers: F.transform(
        answers, lambda a: _named(a=a, raw=text.raw_json(a, F.col("kind")))
    )
    by_hash = lambda items, salt: F.transform(
        F.array_sort(F.transform(items, lambda s: _named(h=_roll(seed, salt, F.col("qid"), s["raw"]), s=s))),
        lambda t: t["s"],
    )
    question = _named(
        qid=F.col("qid"),
        kind=F.col("kind"),
        binary=F.col("binary"),
        n=F.when(F.col("binary"), F.lit(2)).otherwise(n_col).cast("int"),
        quoted=F.col("declared") == F.when(F.col("kind") == "str", "str").otherwise("list"),
        temporal=F.col("question_category").isin("temporal_loc", "temporal_ord"),
        short=F.col("template_type").isin(*SHORT_PHRASE),
        tracking=(F.col("question_category") == "tracking") & (F.col("template_type") == "track_multi"),
        c=by_hash(coded(F.col("correct")), "c"),
        w=by_hash(coded(F.col("incorrect")), "w"),
    )

    def chosen(q: Column, k: Column) -> Column:
        mark = lambda ok: lambda s: _named(
            h=_roll(seed, "s", q["qid"], s["raw"]), a=s["a"], raw=s["raw"], ok=F.lit(ok)
        )
        cc, ww = F.slice(q["c"], 1, k["kc"]), F.slice(q["w"], 1, k["kw"])
        mixed = F.array_sort(F.concat(F.transform(cc, mark(True)), F.transform(ww, mark(False))))
        return _named(cc=cc, ww=ww, singles=mixed)

    def single_options(q: Column, k: Column, s: Column) -> Column:
        mode = F.when(q["temporal"] & ~q["short"], 2).otherwise(1)
        words = lambda x: F.when(q["binary"], F.initcap(F.get(F.get(x["a"], F.lit(0)), F.lit(0)))).otherwise(
            text.single_phrase(x["a"], q["kind"], mode, q["tracking"], noun)
        )
        raw = lambda x: F.when(q["binary"], F.initcap(x["raw"])).otherwise(x["raw"])
        return F.transform(
            s["singles"], lambda x: _option(raw(x), words(x), x["ok"] & (k["kc"] == 1), F.array(x["raw"]))
        )

    def further_options(q: Column, k: Column, s: Column) -> Column:
        """What fills the slots the singles leave open."""
        tags = lambda ok: F.transform(
            F.filter(
                F.transform(s["singles"], lambda x, i: _named(ok=x["ok"], tag=text.label(i, alphabet))),
                lambda t: t["ok"] == ok,
            ),
            lambda t: t["tag"],
        )

        def combined(picked: Column, names: Column, is_correct: Column) -> Column:
            quoted = F.transform(picked, lambda x: text.quoted_answer(x["a"], q["kind"]))
            raws = F.transform(picked, lambda x: x["raw"])
            words = text.several_phrase(
                F.when(q["quoted"], quoted).otherwise(names),
                F.when(q["quoted"], F.lit(noun)).otherwise(F.lit("Option")),
            )
            return _option(
                F.concat(F.lit("["), F.array_join(raws, ", "), F.lit("]")), words, is_correct, raws
            )

        none = lambda ok: _plain(NONE, text.NONE_TEXT[1], ok)
        r = q["n"] - F.size(s["singles"])
        # the answers one "both / all" option would name: the correct ones, all wrong ones, or one of each
        one_each = k["kc"] == 1
        picked = F.when(k["kc"] > 1, s["cc"]).when(one_each, F.concat(F.slice(s["cc"], 1, 1), F.slice(s["ww"], 1, 1))).otherwise(s["ww"])
        names = (
            F.when(k["kc"] > 1, tags(True))
            .when(one_each, F.concat(F.slice(tags(True), 1, 1), F.slice(tags(False), 1, 1)))
            .otherwise(tags(False))
        )
        coin = _number(seed, "coin", q["qid"], F.lit(0), F.lit(2)) == 0

        def fill(both: Column) -> Column:
            only_none = (r == 1) & (q["temporal"] | ~coin)
            return (
                F.when((r <= 0) | q["binary"], F.slice(F.array(none(False)), 1, 0))
                .when(k["kc"] > 1, F.slice(F.array(both, none(False)), 1, r))
                .when(k["kc"] == 0, F.slice(F.array(none(True), both), 1, r))
                .when(only_none, F.array(none(False)))
                .otherwise(F.slice(F.array(both, none(False)), 1, r))
            )

        return text.let(combined(picked, names, k["kc"] > 1), fill)

    def arranged(q: Column, extra: Column) -> Column:
        if add_none_at_end:
            return F.concat(
                F.filter(extra, lambda o: o["raw_json"] != NONE), F.filter(extra, lambda o: o["raw_json"] == NONE)
            )
        keyed = F.transform(extra, lambda o: _named(h=_roll(seed, "x", q["qid"], o["raw_json"]), o=o))
        return F.transform(F.array_sort(keyed), lambda t: t["o"])

    def labelled(every: Column) -> Column:
        if add_abstain:
            every = F.concat(every, F.array(_plain(ABSTAIN, text.ABSTAIN_TEXT[1], False)))
        tag = lambda i: text.label(i, alphabet)
        return F.transform(
            every,
            lambda o, i: _named(
                idx=i, raw_json=o["raw_json"], label=tag(i), text=o["text"],
                full_text=F.concat(text.adorn(tag(i), label_style), F.lit(" "), o["text"]),
                is_correct=o["is_correct"], answers=o["answers"],
            ),
        )

    def complete(options: Column) -> Column:
        lines = F.array_join(F.transform(options, lambda o: F.concat(o["full_text"], F.lit(option_sep))), "")
        return _named(
            options=options,
            correct_option=F.get(F.filter(options, lambda o: o["is_correct"]), F.lit(0)),
            num_options=F.size(options),
            qstr=F.concat(F.col("raw_qstr"), F.lit(preprompt), lines),
        )

    def build(q: Column, k: Column, s: Column) -> Column:
        extra = text.let(further_options(q, k, s), lambda e: arranged(q, e))
        return text.let(labelled(F.concat(single_options(q, k, s), extra)), complete)

    built = text.let(
        question,
        lambda q: text.let(
            _option_counts(q, seed, randomize_options),
            lambda k: text.let(chosen(q, k), lambda s: build(q, k, s)),
        ),
    )
    return df.withColumn("_built", built).select(
        *[c for c in df.columns if c not in ("options", "qstr")],
        "_built.options", "_built.correct_option", "_built.num_options", "_built.qstr",
    )


def assemble_yes_no(
    df: DataFrame,
    seed: int = 42,
    add_abstain: bool = False,
    alphabet: str = "alpha_upper",
    label_style: str = "dot",
    preprompt: str = PREPROMPT,
    option_sep: str = OPTION_SEP,
) -> DataFrame:
    """What :func:`assemble_options` makes of binary questions whose one correct and one wrong answer are "Yes" and "No".

    Both orders are known beforehand, so every value is a plain column of the answer (``truth``: is it yes?)
    and of one comparison of hashes; nothing is mapped over arrays.
    """
    words = ("Yes", "No")
    coded = {word: f'"{word}"' for word in words}
    yes_first = _roll(seed, "s", F.col("qid"), F.lit(coded["Yes"])) < _roll(seed, "s", F.col("qid"), F.lit(coded["No"]))
    rows = df.withColumn("_yes_first", yes_first)

    def option(i: int, raw: Column, shown: Column, is_correct: Column, answers: Column) -> Column:
        tag = text.label(F.lit(i), alphabet)
        return _named(
            idx=F.lit(i), raw_json=raw, label=tag, text=shown, full_text=F.concat(text.adorn(tag, label_style), F.lit(" "), shown),
            is_correct=is_correct, answers=answers,
        )

    def single(i: int) -> Column:
        is_yes = F.col("_yes_first") if i == 0 else ~F.col("_yes_first")
        of = lambda change: F.when(is_yes, change("Yes")).otherwise(change("No"))
        return option(
            i, of(lambda w: F.initcap(F.lit(coded[w]))), of(lambda w: F.initcap(F.lit(w))), is_yes == F.col("truth"),
            F.array(of(lambda w: F.lit(coded[w]))),
        )

    every = [single(0), single(1)]
    if add_abstain:
        every.append(option(2, F.lit(ABSTAIN), F.lit(text.ABSTAIN_TEXT[1]), F.lit(False), F.expr("cast(array() as array<string>)")))
    rows = rows.withColumns({f"_option{i}": o for i, o in enumerate(every)})
    lines = [x for i in range(len(every)) for x in (F.col(f"_option{i}.full_text"), F.lit(option_sep))]
    return rows.select(
        *[c for c in df.columns if c not in ("options", "qstr", "truth")],
        F.array(*[f"_option{i}" for i in range(len(every))]).alias("options"),
        F.when(F.col("_option0.is_correct"), F.col("_option0")).otherwise(F.col("_option1")).alias("correct_option"),
        F.lit(len(every)).alias("num_options"), F.concat(F.col("raw_qstr"), F.lit(preprompt), *lines).alias("qstr"),
    )


def validate_questions(
    df: DataFrame,
    label_style: str = "dot",
    preprompt: str = PREPROMPT,
    option_sep: str = OPTION_SEP,
    extra: Sequence[tuple[str, Column]] = (),
) -> DataFrame:
    """Add ``violations``: names of the checks an assembled question fails.

    ``extra`` are further (name, condition that must hold) pairs.
    """
    lines = F.filter(
        F.transform(
            F.split(F.element_at(F.split("qstr", preprompt), -1), option_sep), lambda line: F.trim(line)
        ),
        lambda line: line != "",
    )
    case = _named(
        options=F.col("options"), truth=F.col("correct_option"), n=F.col("num_options"), lines=lines,
        right=F.transform("correct", lambda a: text.raw_json(a, F.col("kind"))), binary=F.col("binary"),
    )

    def look_up(q: Column) -> Column:
        all_right = lambda o: F.size(F.array_except(o["answers"], q["right"])) == 0
        others = F.filter(
            q["options"], lambda o: (o["idx"] != q["truth"]["idx"]) & ~o["raw_json"].isin(NONE, ABSTAIN)
        )
        flags = F.transform(others, all_right)
        return text.let(
            _named(
                at=F.get(q["options"], q["truth"]["idx"]), line=F.get(q["lines"], q["truth"]["idx"]),
                right_others=F.size(F.filter(flags, lambda f: f)), wrong_others=F.size(F.filter(flags, lambda f: ~f)),
                truth_right=all_right(q["truth"]),
            ),
            lambda v: failed(q, v),
        )

    def failed(q: Column, v: Column) -> Column:
        truth, none = q["truth"], q["truth"]["raw_json"] == NONE
        single = (F.size(truth["answers"]) == 1) & v["truth_right"]
        checks = [
            ("option_count", F.size(q["lines"]) == q["n"]),
            ("no_truth", truth.isNotNull()),
            ("truth_is_abstain", truth["raw_json"] != ABSTAIN),
            ("raw_differs", v["at"]["raw_json"] == truth["raw_json"]),
            ("label_differs", v["at"]["label"] == truth["label"]),
            ("label_in_text", F.split_part(v["line"], F.lit(" "), F.lit(1)) == text.adorn(truth["label"], label_style)),
            ("text_differs", v["line"] == F.trim(truth["full_text"])),
            ("one_other_correct", v["right_others"] != 1),
            ("truth_not_single", (v["wrong_others"] != q["n"] - 1) | none | single | q["binary"]),
            ("truth_not_correct", none | q["binary"] | v["truth_right"]),
            *extra,
        ]
        names = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
        return F.array_compact(names)

    return df.withColumn("violations", text.let(case, look_up))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid questions, and the quarantined ones."""
    return df.filter(F.size("violations") == 0), df.filter(F.size("violations") > 0)


def shuffle_options(source: DataFrame, k: int = 1, options: str = "options", truth: str = "correct_idx") -> DataFrame:
    """The first ``k`` permutations of the options in lexicographic order.

    Adds ``shuffle_idx`` and rewrites the options and the truth indices. The i-th
    permutation is read off i in factorial digits, row by row. At most
    ``size(options)!`` rows come out per question.
    """
    if k < 1:
        raise ValueError("at least one shuffle is needed")
    n = F.size(options)
    rows = source.withColumn(
        "shuffle_idx",
        F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(k), F.factorial(F.least(n, F.lit(20)))) - 1)),
    )
    start = F.struct(
        F.sequence(F.lit(0), n - 1).alias("left"), F.col("shuffle_idx").alias("rest"),
        F.expr("cast(array() as array<int>)").alias("out"),
    )

    def step(acc, i):
        block = F.factorial(F.least(n - 1 - i, F.lit(20)))
        at = F.floor(acc["rest"] / block).cast("int")
        return F.struct(
            F.concat(F.slice(acc["left"], 1, at), F.slice(acc["left"], at + 2, n)).alias("left"),
            (acc["rest"] % block).alias("rest"),
            F.concat(acc["out"], F.array(F.get(acc["left"], at))).alias("out"),
        )

    order = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])
    rows = rows.withColumn("_order", order)
    return rows.withColumns(
        {
            options: F.transform("_order", lambda i: F.get(options, i)),
            truth: F.transform(truth, lambda t: (F.array_position("_order", t) - 1).cast("int")),
        }
    ).drop("_order")


def to_questions(source: DataFrame, seed: int = 42, **flags) -> DataFrame:
    """Annotated questions to complete ones.

    Input: question_no, category, name, video_id, frame_idx (array),
    question_category, template_type, question_params (map to arrays), kind,
    options (array of answers), correct_idx (array), and shuffle_idx if shuffled.
    """
    fixed = source.withColumn(
        "question_category",
        F.when(F.col("template_type").isin(*MOVED_TO_ORDER), F.lit("temporal_ord")).otherwise(
            F.col("question_category")
        ),
    )
    one = lambda values: F.when(F.size(values) == 1, F.concat(F.lit("Part "), F.get(values, F.lit(0)))).otherwise(
        F.raise_error(F.lit("a question parameter must have one value")).cast("string")
    )
    given = lambda a: F.get(F.get(a, F.lit(0)), F.lit(0)) != "none"
    category, template = F.col("question_category"), F.col("template_type")
    size, several = F.size("options"), F.size("correct_idx") > 1
    wanted = size + F.when(several, 1).otherwise(0)
    wanted = wanted + F.when((wanted < 4) & (category != "tracking"), 1).otherwise(0)
    declared = (
        F.when(category == "mating", "str")
        .when(category == "tracking", F.when(template == "track_single", "list").otherwise("str"))
        .when(template.isin("1part_order", "1part_order_last", "edge_order"), "str")
        .otherwise("list")
    )
    has_shuffle = "shuffle_idx" in source.columns
    tail = [F.col("question_no")] + ([F.col("shuffle_idx")] if has_shuffle else [])
    frame = lambda i: F.format_string("%03d", F.get("frame_idx", F.lit(i)))
    mark = F.concat(F.lit("_q"), "question_no", F.lit(".jpg"))
    n_frames = F.size("frame_idx")
    ready = fixed.withColumns(
        {
            "raw_qstr": text.fill(template_text(), F.transform_values("question_params", lambda k, v: one(v))),
            "binary": option_kind() == "binary",
            "correct": F.filter(F.transform("correct_idx", lambda i: F.get("options", i)), given),
            "incorrect": F.filter(
                F.filter("options", lambda o, i: ~F.array_contains("correct_idx", i)), given
            ),
            "_wanted": F.when(category.isin("temporal_loc", "tracking"), wanted).otherwise(F.lit(4)),
            "declared": declared,
            "template_idx": F.lit(0),
            "qid_flat": question_path(category, template, F.lit(0), F.col("category"), F.col("video_id"), *tail),
            "prompt_img_fn": F.when(n_frames == 1, F.concat(F.lit("prompt_"), frame(0), mark)),
            "prompt_img_0_fn": F.when(n_frames == 2, F.concat(F.lit("prompt_"), frame(0), mark)),
            "jumbled_prompt_img_1_fn": F.when(n_frames == 2, F.concat(F.lit("jumbled_prompt_"), frame(1), mark)),
        }
    ).withColumn(
        "qid",
        F.when(n_frames > 2, F.raise_error(F.lit("more than two frames in a question")).cast("string")).otherwise(
            F.sha2("qid_flat", 256)
        ),
    )
    return assemble_options(
        ready.drop("options"), F.col("_wanted"), seed, randomize_options=False, **flags
    ).drop("_wanted")


def scramble(
    questions: DataFrame, masks: DataFrame, mapping: DataFrame, columns: Sequence[str] = ("qstr",)
) -> tuple[DataFrame, DataFrame]:
    """Questions and masks under permuted part ids, one variant per seed.

    ``mapping``: seed, question_no, part_id, display_id. A question has as many
    mapping rows as its furniture has parts, so the map stays small.
    """
    maps = mapping.groupBy("seed", "question_no").agg(
        F.map_from_entries(F.collect_list(F.struct("part_id", "display_id"))).alias("_map")
    )
    renamed = questions.join(maps, "question_no").withColumns(
        {c: text.map_part_ids(F.col(c), lambda p: F.col("_map")[p]) for c in columns}
    ).drop("_map")
    shown = masks.join(mapping, ["question_no", "part_id"]).withColumn(
        "part_id", F.col("display_id")
    ).drop("display_id")
    return renamed, shown


# --- generators ---------------------------------------------------------------------


def _ready(df: DataFrame, category: str, template_type: str, kind: str, binary: bool, params: Mapping[str, Column]) -> DataFrame:
    out = df.withColumns(
        {
            "question_category": F.lit(category), "template_type": F.lit(template_type), "kind": F.lit(kind),
            "declared": F.lit("str"), "binary": F.lit(binary),
        }
    )
    words = {(t[0], t[1]): t[3] for t in TEMPLATES}[category, template_type]
    filled = F.lit(words)
    for name, value in params.items():
        filled = F.replace(filled, F.lit(f"{{{name}}}"), value)
    return out.withColumn("raw_qstr", filled)


def _answers(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.array(F.array(p)))


def make_1part(
    frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str], strategy: str = "subasm", k: int = 3,
    seed: int = 42, **flags,
) -> DataFrame:
    """Which part is connected to the query part? ``k`` query parts per frame."""
    picked = graph.pick_parts(frame_parts, frame, strategy, k, seed).select(*frame, "part_id", "pick")
    near = graph.with_neighbours(frame_parts, edges, frame).join(picked, [*frame, "part_id"])
    rows = near.filter(F.size("connected") + F.size("unconnected") >= 2).select(
        *frame, "furniture_id", "part_id", "pick",
        F.concat_ws("/", F.lit("mating"), F.lit("1part"), *frame, "part_id").alias("qid"),
        _answers(F.col("connected")).alias("correct"), _answers(F.col("unconnected")).alias("incorrect"),
    )
    params = {"query_part": F.concat(F.lit("Part "), F.col("part_id"))}
    return assemble_options(_ready(rows, "mating", "1part", "str", False, params), 4, seed, **flags)


def make_2part(
    frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str], strategy: str = "size_h2l", k: int = 3,
    seed: int = 42, template_type: str = "2parts", **flags,
) -> DataFrame:
    """Are two parts connected? The best ``k`` pairs per frame, named in random order."""
    pairs = graph.pick_pairs(frame_parts, frame, strategy, k, seed)
    known = edges.select("furniture_id", F.col("src").alias("part_a"), F.col("dst").alias("part_b")).distinct()
    rows = pairs.join(F.broadcast(known.withColumn("_edge", F.lit(True))), ["furniture_id", "part_a", "part_b"], "left")
    qid = F.concat_ws("/", F.lit("mating"), F.lit(template_type), *frame, "part_a", "part_b")
    rows = rows.withColumns({"qid": qid, "connected": F.coalesce("_edge", F.lit(False))}).drop("_edge")
    swap = F.substring(_roll(seed, "swap", F.col("qid")), 1, 1) < "8"
    yes, no = F.array(F.array(F.lit("Yes"))), F.array(F.array(F.lit("No")))
    rows = rows.withColumns(
        {
            "correct": F.array(F.when(F.col("connected"), yes).otherwise(no)),
            "incorrect": F.array(F.when(F.col("connected"), no).otherwise(yes)),
            "_first": F.when(swap, F.col("part_b")).otherwise(F.col("part_a")),
            "_second": F.when(swap, F.col("part_a")).otherwise(F.col("part_b")),
        }
    )
    params = {"query_part1": F.concat(F.lit("Part "), F.col("_first")), "query_part2": F.concat(F.lit("Part "), F.col("_second"))}
    ready = _ready(rows, "mating", template_type, "str", True, params).drop("_first", "_second")
    return assemble_yes_no(ready.withColumn("truth", F.col("connected")), seed, **flags)


def in_hash_order(
    rows: DataFrame, by: Sequence[str], value: Sequence[str], seed: int, salt: str, out: str
) -> DataFrame:
    """All rows of a group by hash, as an array of string arrays.

    A group is a frame's part pairs, which its furniture's vocabulary of parts bounds.
    """
    keyed = rows.select(
        *by, *value, F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), *by, *value)).alias("_h")
    )
    return keyed.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_h", *value))),
            lambda s: F.array(*[s[v] for v in value]),
        ).alias(out)
    )


def make_find_edges(
    frame_parts: DataFrame, edges: DataFrame, frame: Sequence[str], n: int = 4, seed: int = 42, **flags
) -> DataFrame:
    """Which shown parts are connected? One question per frame with at least two pairs."""
    by = [*frame, "furniture_id"]
    yes = graph.visible_edges(frame_parts, edges, frame)
    no = graph.non_edges(frame_parts, edges, frame)
    right = in_hash_order(yes, by, ["src", "dst"], seed, "edge", "_yes")
    wrong = in_hash_order(no, by, ["src", "dst"], seed, "gap", "_no")
    none = F.expr("cast(array() as array<array<string>>)")
    lists = right.join(wrong, by, "full_outer").withColumns(
        {"_yes": F.coalesce("_yes", none), "_no": F.coalesce("_no", none)}
    ).filter(F.size("_yes") + F.size("_no") >= 2)
    rows = lists.select(
        *by, F.concat_ws("/", F.lit("mating"), F.lit("find_edges"), *frame).alias("qid"),
        F.transform("_yes", lambda e: F.array(e)).alias("correct"),
        F.transform("_no", lambda e: F.array(e)).alias("incorrect"),
    )
    return assemble_options(_ready(rows, "mating", "find_edges", "list", False, {}), n, seed, **flags)


def role_index(parts: DataFrame, by: Sequence[str], semantics: str = "semantics", erase: bool = True) -> DataFrame:
    """Distinct (role, part) rows from comma-separated role names."""
    role = F.lower(F.trim(F.col("_role")))
    return (
        parts.select(*by, "part_id", F.explode(F.split(semantics, ",")).alias("_role"))
        .select(*by, (text.erase_positional(role) if erase else role).alias("role"), "part_id")
        .distinct()
    )


def role_sizes(roles: DataFrame, subassembly: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean size of the sub-assemblies that hold a role's parts, and its smallest.

    Roles without all columns of ``by`` hold for every group: they are the parts' vocabulary and broadcast.
    """
    on = [c for c in (*by, "part_id") if c in roles.columns]
    names = roles if len(on) > len(by) else F.broadcast(roles)
    sized = subassembly.select(*by, "part_id", "subasm_size").join(names, on)
    return sized.groupBy(*by, "role").agg(
        F.avg("subasm_size").alias("mean_size"), F.min("subasm_size").alias("min_size"),
        F.count(F.lit(1)).alias("n_parts"),
    )


def make_role_questions(
    roles: DataFrame, frame_parts: DataFrame, frame: Sequence[str], k: int = 3, n: int = 4, seed: int = 42,
    category: Column | None = None, **flags,
) -> DataFrame:
    """Which part forms the role? The ``k`` roles with the smallest sub-assemblies per frame.

    ``frame_parts`` has subasm_size (null: in no sub-assembly). Only a role's
    parts of its smallest sub-assembly count as correct; frames of one or two
    parts give no question.
    """
    by = [*frame, "furniture_id"]
    seen = frame_parts.select(*by, "part_id", "subasm_size")
    shown = seen.groupBy(*by).agg(F.collect_set("part_id").alias("_shown")).filter(F.size("_shown") > 2)
    members = seen.join(F.broadcast(roles), ["furniture_id", "part_id"])
    stats = members.groupBy(*by, "role").agg(
        F.avg("subasm_size").alias("_mean"), F.min("subasm_size").alias("_least")
    )
    # Roles without a shown part have mean 0. The first k of them by name are among the first
    # k + (roles shown) of the furniture, so a frame meets no more than these.
    every = roles.groupBy("furniture_id").agg(F.array_sort(F.collect_set("role")).alias("_roles"))
    present = stats.groupBy(*by).agg(F.collect_set("role").alias("_present"))
    frames = shown.select(*by).join(present, by, "left").join(F.broadcast(every), "furniture_id")
    has = F.coalesce("_present", F.slice("_roles", 1, 0))
    absent = F.slice(F.array_except(F.slice("_roles", F.lit(1), F.size(has) + k), has), 1, k)
    least = stats.schema["_least"].dataType
    ranked = stats.join(shown.select(*by), by, "left_semi").withColumn("_mean", F.coalesce("_mean", F.lit(0.0))).unionByName(
        frames.select(*by, F.explode(absent).alias("role"), F.lit(0.0).alias("_mean"), F.lit(None).cast(least).alias("_least"))
    )
    chosen = graph.first_of(ranked, by, ["_mean", "role"], k)
    right = members.join(chosen.select(*by, "role", "_least"), [*by, "role"]).filter(
        F.col("_least").isNull() | (F.col("subasm_size") == F.col("_least"))
    ).groupBy(*by, "role").agg(F.collect_set("part_id").alias("_right"))
    rows = chosen.join(right, [*by, "role"], "left").join(shown, by)
    hits = F.array_sort(F.coalesce("_right", F.slice("_shown", 1, 0)))
    template = "sgc_1part" if category is None else "sgc_1part_w_cat"
    rows = rows.select(
        *by, "role", "pick", F.concat_ws("/", F.lit("correspondence"), F.lit(template), *frame, "role").alias("qid"),
        _answers(hits).alias("correct"), _answers(F.array_except("_shown", hits)).alias("incorrect"),
        *([category.alias("_category")] if category is not None else []),
    )
    named = {"semantic_role": F.col("role")} | ({"category": F.col("_category")} if category is not None else {})
    ready = _ready(rows, "correspondence", template, "str", False, named)
    return assemble_options(ready, n, seed, **flags)
