"""Token-level operators that need a table: lemmas and stems."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.columns import has_text
from opinio.session import keep, keep_texts, kept

#: Rows of a table of replacements that tasks look words up in; a larger one is joined.
LOOKED_UP = 1 << 18

#: Stems that a task's process remembers.
STEMS_AT_HAND = 1 << 16


def one_per_row(df: DataFrame, array: Column | str, name: str, *kept: Column | str) -> DataFrame:
    """One row per array entry with the kept columns.

    A plain explode makes the optimizer test the array for emptiness at the scan, which
    works a costly text expression out twice; the outer form and a filter do not.
    """
    array = F.col(array) if isinstance(array, str) else array
    rows = df.select(*kept, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def with_text(df: DataFrame, column: str, *kept: Column | str) -> DataFrame:
    """The kept columns and the text of the rows that carry text.

    A filter on a text that is worked out by the query would be pushed below its
    projection, and the text be worked out twice; a generated row is not.
    """
    return one_per_row(df, F.array(F.when(has_text(column), F.col(column))), column, *kept)


def kept_texts(df: DataFrame, column: str, *kept_columns: Column | str) -> DataFrame:
    """``with_text``, worked out once: on disk, unless the frame is cached already."""
    rows = with_text(df, column, *kept_columns)
    return rows if kept(df) else keep_texts(rows)


def explode_tokens(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, pos, token)`` rows; a document without tokens gives one row of nulls.

    Documents are laid out by key before they are taken apart, so putting them together
    again needs no shuffle of token rows.
    """
    rows = df.select(key, tokens).repartition(key)
    return rows.select(F.col(key), F.posexplode_outer(tokens).alias("pos", "token"))


def regroup_tokens(rows: DataFrame, key: str, token: Column, name: str) -> DataFrame:
    """``(key, name)`` with the tokens of each document in order. The key must be unique."""
    # One document's tokens; the null entry of an empty one is not collected.
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", token.alias("token")))
    ordered = F.sort_array(F.collect_list(entry))
    return rows.groupBy(key).agg(F.transform(ordered, lambda t: t["token"]).alias(name))


def together(lists: Column, tokens: str) -> dict[str, Column]:
    """Of the token lists of the rows that share a key one list, and its tokens' places if there are several."""
    places = F.flatten(F.transform(lists, lambda l: F.transform(l, lambda t, i: i)))
    return {tokens: F.flatten(lists), "_places": F.when(F.size(lists) > 1, places)}


def in_order(tokens: str) -> Column:
    """What ``together`` gave: tokens of several rows by place, then by word."""
    placed = F.zip_with("_places", tokens, lambda i, t: F.struct(i.alias("pos"), t.alias("token")))
    several = F.transform(F.sort_array(placed), lambda t: t["token"])
    return F.when(F.col("_places").isNull(), F.col(tokens)).otherwise(several)


def change_tokens(df: DataFrame, key: str, tokens: str, change: Callable[[str], Column], name: str) -> DataFrame:
    """``(key, name)`` with changed tokens, one row per key. Lists move whole: a token is never a row.

    Nothing moves in a frame that is laid out by key.
    """
    lists = df.select(key, F.col(tokens).alias("_tokens")).groupBy(key).agg(F.collect_list("_tokens").alias("_lists"))
    rows = lists.withColumns(together(F.col("_lists"), "_tokens")).withColumn("_tokens", change("_tokens"))
    return rows.select(key, in_order("_tokens").alias(name))


def each_distinct(change: Callable[[pa.Array], pa.Array]):
    """A function of a token list that changes its words, each different one of a batch once."""

    @F.arrow_udf("array<string>")
    def changed(tokens: pa.Array) -> pa.Array:
        coded = tokens.flatten().dictionary_encode()
        words = change(coded.dictionary)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32()))
        upto = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(upto, words.take(coded.indices), mask=tokens.is_null())

    return changed


def lookup(mapping: DataFrame):
    """A function of a token list that maps every token through ``(token, replacement)``.

    None if the table has more than ``LOOKED_UP`` rows or a token twice: then it is joined.
    """
    known = mapping.select("token", "replacement").filter("token is not null and replacement is not null")
    # At most LOOKED_UP rows and one.
    table = known.limit(LOOKED_UP + 1).toArrow()
    forms, others = (pa.array(table.column(c).to_pylist(), pa.string()) for c in ("token", "replacement"))
    if len(forms) > LOOKED_UP or len(forms.unique()) < len(forms):
        return None
    return each_distinct(lambda words: pc.coalesce(others.take(pc.index_in(words, value_set=forms)), words))


def replace_tokens(df: DataFrame, key: str, tokens: str, mapping: DataFrame, name: str) -> DataFrame:
    """Map every token through ``(token, replacement)``; unmapped tokens stay.

    In a small table tasks look the words up, document by document. A large one is joined:
    Spark picks the join by the table's measured size and splits a frequent token's rows.
    """
    mapping = keep(mapping.select("token", "replacement"))
    replaced = lookup(mapping)
    if replaced is not None:
        return change_tokens(df, key, tokens, replaced, name)
    return join_tokens(df, key, tokens, mapping, name)


def join_tokens(df: DataFrame, key: str, tokens: str, mapping: DataFrame, name: str) -> DataFrame:
    """``replace_tokens`` for a table of any size."""
    rows = explode_tokens(df, key, tokens).join(mapping.select("token", "replacement"), "token", "left")
    return regroup_tokens(rows, key, F.coalesce("replacement", "token"), name)


def lemma_mapping(lemmas: DataFrame) -> DataFrame:
    return lemmas.select(F.col("form").alias("token"), F.col("lemma").alias("replacement"))


# Endings of inflected nouns and what stands in their place.
ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


def lemmas_by_rule(forms: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(form, lemma)`` of the forms whose lemma is another word.

    ``forms`` has distinct ``form``, ``dictionary`` the base words as ``lemma``, ``exceptions``
    irregular ``(form, lemma)``. A form becomes the shortest word of the dictionary among
    itself, its irregular lemmas and, where it has none of those, itself with one ending
    replaced. Forms of which the dictionary holds none stay as they are. Only distinct forms
    are joined, so the table may be applied to texts of any number.
    """
    form = F.col("form")
    itself = F.struct(F.lit(0).alias("rule"), form.alias("lemma"))
    detached = [
        F.when(form.endswith(end), F.struct(F.lit(i).alias("rule"), F.concat(F.expr(f"left(form, length(form) - {len(end)})"), F.lit(by)).alias("lemma")))
        for i, (end, by) in enumerate(ENDINGS, 1)
    ]
    candidates = forms.select("form", F.explode(F.array_compact(F.array(itself, *detached))).alias("c")).select("form", "c.*")
    if exceptions is not None:
        irregular = exceptions.select("form", F.lit(1).alias("rule"), "lemma")
        regular = candidates.join(irregular.select("form").distinct(), "form", "left_anti")
        own = irregular.join(forms, "form", "left_semi")
        candidates = regular.unionByName(own).unionByName(candidates.filter("rule = 0").join(own.select("form").distinct(), "form", "left_semi"))
    known = candidates.join(dictionary.select("lemma").distinct(), "lemma", "left_semi")
    best = known.groupBy("form").agg(F.min(F.struct(F.length("lemma").alias("n"), "rule", "lemma")).alias("best"))
    return best.select("form", F.col("best.lemma").alias("lemma")).filter("form <> lemma")


def lemmatize_tokens(df: DataFrame, key: str, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Lemmas from a table ``(form, lemma)``, one row per form."""
    return replace_tokens(df, key, tokens, lemma_mapping(lemmas), "lemmas")


# --- Porter (1980) suffix stripping --------------------------------------------------

# Shapes of the published algorithm. A stem's measure counts its
# vowel-consonant groups; y is a vowel after a consonant.
_C = r"[^aeiou][^aeiouy]*"
_V = r"[aeiouy][aeiou]*"
_MEASURE_1 = re.compile(rf"(?:{_C})?{_V}{_C}").match
_MEASURE_EXACT_1 = re.compile(rf"(?:{_C})?{_V}{_C}(?:{_V})?$").match
_MEASURE_2 = re.compile(rf"(?:{_C})?{_V}{_C}{_V}{_C}").match
_HAS_VOWEL = re.compile(rf"(?:{_C})?[aeiouy]").match
_DOUBLE = re.compile(r"([^aeiouylsz])\1$").search
_SHORT = re.compile(rf"{_C}[aeiouy][^aeiouwxy]$").match

# Suffix tables of steps 2, 3 and 4.
_STEP_2 = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("abli", "able"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
)
_STEP_3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)
_STEP_4 = (
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
)


_STEP_2, _STEP_3 = dict(_STEP_2), dict(_STEP_3)


def _suffix(w: str, suffixes: Iterable[str], longest: int) -> str | None:
    """The longest of the suffixes that the word ends in."""
    return next((w[-n:] for n in range(longest, 1, -1) if w[-n:] in suffixes), None)


@lru_cache(maxsize=STEMS_AT_HAND)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters are left alone."""
    if len(w) <= 2:
        return w
    # Step 1a: plurals.
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # Step 1b: past tense and gerund.
    if w.endswith("eed"):
        w = w[:-1] if _MEASURE_1(w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        bare = w[:-2] if w.endswith("ed") else w[:-3]
        if _HAS_VOWEL(bare):
            w = bare
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE(w):
                w = w[:-1]
            elif _SHORT(w) and _MEASURE_EXACT_1(w):
                w += "e"
    # Step 1c: final y.
    if w.endswith("y") and _HAS_VOWEL(w[:-1]):
        w = w[:-1] + "i"
    # Steps 2 and 3: the longest suffix becomes another where the stem is long enough.
    for table, longest in ((_STEP_2, 7), (_STEP_3, 5)):
        suffix = _suffix(w, table, longest)
        if suffix and _MEASURE_1(w[: -len(suffix)]):
            w = w[: -len(suffix)] + table[suffix]
    # Step 4: suffix removal for longer stems; "ion" only after s or t.
    suffix = _suffix(w, _STEP_4, 5)
    if suffix:
        bare = w[: -len(suffix)]
        if _MEASURE_2(bare) and (suffix != "ion" or bare.endswith(("s", "t"))):
            w = bare
    # Step 5: final e and double l.
    if w.endswith("e") and (_MEASURE_2(w[:-1]) or _MEASURE_EXACT_1(w[:-1]) and not _SHORT(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _MEASURE_2(w[:-1]):
        w = w[:-1]
    return w


def _stemmed(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())


def stems(tokens: Column | str) -> Column:
    """The stems of a token list. Every distinct token of a batch is stemmed once."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    # Lower case is Spark's; what is left alone keeps its own.
    lowered = F.transform(tokens, lambda t: F.when(F.length(t) <= 2, t).otherwise(F.lower(t)))
    return each_distinct(_stemmed)(lowered)


def with_stem(df: DataFrame, token: str = "token") -> DataFrame:
    """Add ``stem`` without moving a row."""
    return df.withColumn("stem", F.get(stems(F.array(token)), F.lit(0)))


def stem_tokens(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, stems)``, document by document: what a task holds does not grow with the words."""
    return change_tokens(df, key, tokens, stems, "stems")
