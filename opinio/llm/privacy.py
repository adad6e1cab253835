"""Personal data: generators propose spans, calibrated boosted trees select among them.

Mail and network addresses, card and telephone numbers that pass their checks are always
taken. Further generators, and matches that fail a check, are open candidates. Of them, a
number behind a telling word and a written address that reads as one are told by
``likely`` and taken. Trees trained on what it says of the open candidates of all texts
see format and the rest of the context, not the telling words, and add what looks the
same. Their threshold is the lowest score that keeps the asked-for precision over open
candidates on rows held out from the trees.

Everything is SQL expressions and Spark ML: a pattern's matches come from one extraction,
their places from the lengths of the pieces between them. All repeats are possessive and
starts are anchored, so that time stays linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.boosting import fit
from opinio.llm.common import query, table, work_table

# The kinds in the order that ties follow, base kinds first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "written_email")

LOCAL = r"[A-Za-z0-9._%+-]"
# Anchored at the start of a run of local characters, or where the last match ended: no
# later start in a run can match where its first fails.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
    "written_email": rf"(?<!{LOCAL}){LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
}

#: What a text must contain for a pattern to be worth trying.
HINTS = {"email": ("@",), "phone": ("+",), "written_email": ("at)", "at]")}

#: Words behind which a number is a telephone or an account; little may stand between.
TELLING = r"(?i)(?<!\p{L})(?:tele(?:phone|fon|fono)|t[eé]l(?:[eé]phone|[eé]fono)?|(?:tele)?fax|(?:cell|smart)?phone|handy|call(?:\x20me|\x20us)?|mobil\p{L}{0,3}|m[oó]vil|cell|contact|whatsapp|ring|account|acct|konto|cuenta|compte)(?:\x20(?:number|no|nr|is|at|on))*[\x20.:=#(+-]*$"
ADDRESS = rf"^{LOCAL}++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{{2,}}$"
NUMBERED = r"(?i)(?:\bid|\bno|\bnr|order|ref|isbn|version|[#$€=])[\x20:.]*$"
CONTEXT = 30


@dataclass(frozen=True)
class Choice:
    #: Share of the selected candidates that must pass their check on held-out rows.
    precision: float = 0.99


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, as an array of ``(gap, value, left, right)``.

    ``gap`` is the number of code points since the match before, ``left`` the last of them and
    ``right`` the one behind the match. Every match is looked at once: its place is the sum
    of what comes before, which is left to a running sum over rows.
    """
    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")
    )

    def spans(m: Column) -> Column:
        value = lambda i: F.coalesce(F.get(m["values"], i), F.lit(""))

        def span(v: Column, i: Column) -> Column:
            gap, after = F.get(m["gaps"], i), F.get(m["gaps"], i + 1)
            before = F.concat(F.right(value(i - 1), F.lit(1)), gap)
            return F.struct(
                F.length(gap).alias("gap"),
                v.alias("value"),
                F.right(before, F.lit(CONTEXT)).alias("left"),
                F.left(F.concat(after, F.left(value(i + 1), F.lit(1))), F.lit(1)).alias("right"),
            )

        return F.transform(m["values"], span)

    # Bound to a name first: both lists are worked out once, not once per match.
    return F.get(F.transform(F.array(both), spans), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(digits, ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a base kind; the others fail it."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        parts = F.split(value, r"\.")
        return F.forall(parts, small) & F.forall(parts, lambda p: F.substring(p, -3, 3).cast("int") <= 255)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def likely(kind: str, span: Column) -> Column:
    """Whether a candidate of a further kind is told to be personal; false for base kinds."""
    value = span["value"]
    if kind == "number":
        return F.length(_digits(value)).between(7, 15) & span["left"].rlike(TELLING)
    if kind == "written_email":
        plain = F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@")
        return F.regexp_replace(plain, r"\x20?[(\[]dot[)\]]\x20?", ".").rlike(ADDRESS)
    return F.lit(False)


def _features(span: Column) -> Column:
    """Format and context of a candidate, none of it what a check or ``likely`` looks for."""
    value, left, right = span["value"], span["left"], span["right"]
    digits = _digits(value)
    groups = F.split(value, "[^0-9]+")
    flag = lambda c: c.cast("double")
    return F.array(
        F.length(value).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(value, "[^.]", "")).cast("double"),
        F.length(F.regexp_replace(value, r"[^\x20()/-]", "")).cast("double"),
        F.size(groups).cast("double"),
        F.array_max(F.transform(groups, F.length)).cast("double"),
        F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        flag(F.substring(value, 1, 1) == "+"),
        flag(left.rlike(NUMBERED)),
        flag(left.rlike(r"[\p{L}\p{N}._-]$")),
        flag(right.rlike(r"[\p{L}\p{N}_-]")),
        flag(left.rlike(r"[+]$")),
    )


CANDIDATE = "struct<kind:int,at:int,gap:int,length:int,good:boolean,likely:boolean,features:array<double>>"
SPAN = "struct<start:int,kind:int,end:int>"
NO_SPANS = f"array<{SPAN}>"


def _described(kind: str, number: int):
    def describe(s: Column, i: Column) -> Column:
        good = F.coalesce(passes(kind, s["value"]), F.lit(False))
        # What passes its check is taken anyway: nothing more need be known of it.
        features = F.when(~good, _features(s))
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("at"),
            s["gap"].alias("gap"),
            F.length(s["value"]).alias("length"),
            good.alias("good"),
            F.coalesce(likely(kind, s), F.lit(False)).alias("likely"),
            features.alias("features"),
        )

    return describe


def candidates(text: Column) -> Column:
    """All proposed spans of a text, as an array of ``CANDIDATE``; ``good`` ones pass a check.

    ``gap`` counts the code points since the match of the same kind before it.
    """
    by_kind = []
    for i, kind in enumerate(KINDS):
        spans = F.transform(found(text, PATTERNS[kind]), _described(kind, i))
        hinted = text.rlike("[0-9]")
        if kind in HINTS:
            hinted = reduce(or_, [text.contains(h) for h in HINTS[kind]])
        by_kind.append(F.when(hinted, spans.cast(f"array<{CANDIDATE}>")).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    return F.concat(*by_kind)


def places(rows: DataFrame) -> DataFrame:
    """A row per candidate of ``rows`` (``_row``, ``_all``) with ``start`` and ``end``, and ``open``.

    Open candidates pass no check and overlap no span that does; of a failed match of a base
    kind and a further kind's candidate for the same stretch, the latter is open. Overlaps
    show in the greatest end of what begins before and the next start of what begins
    after, each a running value along a text's candidates.
    """
    # One exchange: all windows below partition by the row, the first also by its kind.
    each = rows.select("_row", F.inline("_all")).repartition("_row")
    along = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(along)
    each = each.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("length"))
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def meets(which: Column) -> Column:
        left = F.max(F.when(which, F.col("end"))).over(before) > F.col("start")
        right = F.min(F.when(which, F.col("start"))).over(after) < F.col("end")
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    further = F.col("kind") >= len(BASE_KINDS)
    free = ~F.col("good") & ~meets(F.col("good")) & (further | ~meets(further))
    return each.withColumn("open", free).select("_row", "start", "kind", "end", "good", "likely", "open", "features")


def _spans_of(chosen: DataFrame) -> DataFrame:
    """``(_row, base, spans, stretches)`` of chosen candidates.

    A stretch is what overlapping spans cover together, under the first one's kind.
    """
    earlier = Window.partitionBy("_row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("_row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True))
    each = chosen.withColumn("_begins", begins.cast("int")).withColumn("_stretch", F.sum("_begins").over(so_far))
    span = F.struct("start", "kind", "end").cast(SPAN)
    whole = each.withColumn("_until", F.max("end").over(Window.partitionBy("_row", "_stretch")))
    stretch = F.struct("start", "kind", F.col("_until").alias("end")).cast(SPAN)
    return whole.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("_begins") == 1, stretch))).alias("stretches"),
    )


def _marked(docs: DataFrame, choice: Choice, carried: list[str]) -> DataFrame:
    """``(_doc, base, spans, stretches)`` per row; ``_doc`` holds the columns to carry."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*carried).alias("_doc"), candidates(text).alias("_all"))
    rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_some": F.size("_all") > 0})
    rows = work_table(rows, "privacy-rows")
    each = work_table(places(rows.filter("_some")), "privacy-candidates")
    calibrate = F.pmod(F.xxhash64("_row", F.lit("calibrate")), F.lit(3)) == 0
    open_ = each.filter("open")
    shown = open_.select("features", F.col("likely").cast("int").alias("label"), calibrate.alias("calibrate"))
    model = fit(shown, parts=None)
    if model.trees is None:
        extra = open_.filter("likely")
    else:
        limit = _threshold(model, shown.filter("calibrate"), choice.precision)
        extra = model.score(open_).filter(F.col("likely") | (F.col("score") >= limit))
    columns = ["_row", "start", "kind", "end", "good"]
    spans = _spans_of(each.filter("good").select(*columns).unionByName(extra.select(*columns)))
    # Rows without candidates stay where they are: only the others are met with spans.
    found, none = ("base", "spans", "stretches"), F.array().cast(NO_SPANS)
    met = rows.filter("_some").select("_row", "_doc").join(spans, "_row", "left")
    met = met.select("_doc", *[F.coalesce(c, none).alias(c) for c in found])
    return met.unionByName(rows.filter("not _some").select("_doc", *[none.alias(c) for c in found]))


def personal_spans(docs: DataFrame, choice: Choice = Choice(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` rows (``doc_id``, the columns in ``keep``) with ``base``, ``spans`` and ``stretches``.

    Arrays of ``(start, kind, end)``, sorted; ``kind`` numbers ``KINDS``, places
    count code points, ends are exclusive. ``base`` holds what passes a check, ``spans``
    also the likely and the selected candidates that no base span overlaps, ``stretches``
    what spans cover, overlapping ones as one. A null text is empty and has
    no spans. Repeated rows each keep their own row; null ids, clashing names of other
    columns and an empty table are fine. Time and memory grow with a text's candidates in proportion.
    Where the texts hold too few candidates to learn from, only the likely ones are added.
    """
    marked = _marked(docs, choice, list(dict.fromkeys(["doc_id", *keep])))
    return marked.select("_doc.doc_id", *[F.col("_doc")[c].alias(c) for c in keep], "base", "spans", "stretches")


def redact(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets; ``n_chars``, if there, follows.

    Texts without personal data, null ones included, and all other columns stay as they are.
    """
    marked = _marked(docs, choice, docs.columns)
    changed, text = F.size("stretches") > 0, F.col("_doc.text")
    new = {"text": F.when(changed, redacted(text, F.col("stretches"))).otherwise(text)}
    rows = marked.select("_doc", new["text"].alias("_text"), changed.alias("_changed"))
    values = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length("_text").cast(kind)
        values["n_chars"] = F.when(F.col("_changed"), length).otherwise(F.col("_doc.n_chars"))
    return rows.select(*[values.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def _threshold(model, held: DataFrame, precision: float) -> float:
    """Lowest score from which on held-out open candidates are likely at the asked-for rate."""
    scored = model.score(held.select(F.col("label").alias("good"), "features"))
    steps = F.floor(F.col("score") * 1000)
    by_score = scored.groupBy(steps.alias("step")).agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    best, good, n = 2.0, 0, 0  # beyond any score: nothing is selected
    for row in by_score.orderBy(F.desc("step")).collect():  # a thousand steps at most
        good, n = good + row["good"], n + row["n"]
        if good >= precision * n:
            best = row["step"] / 1000
    return max(best, 0.001)


#: Stretches cut out of one piece of a text: finding a place in a text takes time with its distance.
TOGETHER = 256


def redacted(text: Column | str, stretches: Column | str) -> Column:
    """The text with each stretch replaced by its kind in brackets; stretches do not overlap."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    stretches = F.col(stretches) if isinstance(stretches, str) else stretches
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    n = F.size(stretches)

    def piece(block: Column) -> Column:
        """From the start of a block's first stretch to that of the next block's."""
        first = block * TOGETHER
        begin = F.get(stretches, first)["start"]
        until = F.coalesce(F.get(stretches, first + TOGETHER)["start"], F.length(text))
        bound = F.struct(F.substring(text, begin + 1, until - begin).alias("text"), F.slice(stretches, first + 1, TOGETHER).alias("own"), begin.alias("begin"))

        def cut(p: Column) -> Column:
            def after(s: Column, i: Column) -> Column:
                # The kind, then the text up to the next stretch.
                next_ = F.coalesce(F.get(p["own"], i + 1)["start"], p["begin"] + F.length(p["text"]))
                kept = F.substring(p["text"], s["end"] - p["begin"] + 1, next_ - s["end"])
                return F.concat(F.element_at(names, s["kind"] + 1), kept)

            return F.array_join(F.transform(p["own"], after), "")

        return F.get(F.transform(F.array(bound), cut), F.lit(0))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / TOGETHER).cast("int"))
    start = F.substring(text, F.lit(1), F.get(stretches, F.lit(0))["start"])
    return F.when(n == 0, text).otherwise(F.concat(start, F.array_join(F.transform(blocks, piece), "")))


def digest(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


@query("op7_privacy")
def op7_privacy(spark, sf_dir):
    rows = personal_spans(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[_count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)],
        F.sha2(digest("base"), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
