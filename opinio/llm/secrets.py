"""Secret scan: a random forest removes false positives among candidate findings.

Candidates come from generators with high recall: known key formats, values assigned to
telling names, and any long code-like token. The forest sees a candidate's length, how
unlikely its character transitions are in the corpus, how much of it dictionary words
cover, whether it stands in a path or address, and its neighbouring words; never the
generator's name. Transitions and dictionary are counted over the whole corpus. The forest
learns from labelled findings; where none are given, those of which the format alone
decides serve: documented key formats and mixed values assigned to telling names are
secrets; plain numbers, words, file and host names, dates and repeated signs are not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: Findings learned from, at most about so many, by hash.
FINDINGS = 40_000

#: A dictionary word is at least one of so many words of the texts, so there are no more of them.
DICTIONARY = 50_000

# Public key formats and telling names, in alphabetical order.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[oprsu]_[A-Za-z0-9]{36}\b",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
}
NAMES = r"(?:access[_-]?key|api[_-]?key|auth|credential|passwd|password|private[_-]?key|pwd|secret|token)"

ASSIGNED = re.compile(rf"(?i)\b{NAMES}[\w-]{{0,16}}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"'<>,;]{{6,}})")
KNOWN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS.items()))
CODE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])[A-Za-z0-9+/_-][A-Za-z0-9+/_=.-]{14,}")
HARMLESS = re.compile(r"[0-9.-]+|[a-z]+|(?:[A-Za-z]+[-_./])+[A-Za-z]+[0-9]{0,4}|(.)\1+|\d{4}-\d{2}-\d{2}.*|.*\.(?:html?|png|jpe?g|css|js|pdf)|(?:[A-Za-z0-9-]+\.)+[a-z]{2,6}")

NEIGHBOURS = re.compile(r"[A-Za-z]{2,}")
TELLING = re.compile(rf"(?i){NAMES}")
AROUND = 40
BUCKETS = 8

SCALARS = 16
N_FEATURES = SCALARS + BUCKETS

ALPHABET = 128


def _symbols(text: bytes) -> np.ndarray:
    return np.minimum(np.frombuffer(text, dtype=np.uint8), ALPHABET - 1)


def transition_counts(docs: DataFrame) -> np.ndarray:
    """How often each character follows each in all texts; beyond ASCII is one character."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = _symbols((text.as_py() or "").encode("utf-8", "replace")).astype(np.int32)
                if len(s) > 1:
                    total += np.bincount(s[:-1] * ALPHABET + s[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(ALPHABET * ALPHABET)
    for row in found.collect():  # a row per pair of the alphabet at most
        out[row["pair"]] = row["n"]
    return out.reshape(ALPHABET, ALPHABET)


def dictionary(docs: DataFrame, one_of: int = DICTIONARY) -> list[str]:
    """The words of four letters or more that are at least one of ``one_of`` of all that are repeated.

    There cannot be more than ``one_of`` such words, whatever the texts, so none is left out and
    only they reach the driver.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    common = words.filter(F.length("word") >= 4).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = work_table(common.filter("n > 1"), "secret-words")
    total = common.agg(F.sum("n")).first()[0] or 0
    return sorted(r["word"] for r in common.filter(F.col("n") * one_of >= total).select("word").collect())


@lru_cache(maxsize=2)
def _model(blob: str) -> tuple[np.ndarray, dict[str, tuple[int, ...]]]:
    """Log odds, and the words by their first four letters: lengths from the longest on."""
    spec = json.loads(blob)
    lengths: dict[str, set[int]] = {}
    for word in spec["words"]:
        lengths.setdefault(word[:4], set()).add(len(word))
    known: dict[str, tuple[int, ...]] = {w: () for w in spec["words"]}
    return np.array(spec["transitions"]), {**known, **{"^" + b: tuple(sorted(n, reverse=True)) for b, n in lengths.items()}}


def corpus_model(docs: DataFrame) -> str:
    """What candidates are measured against, as one small text: log odds and words."""
    counts = transition_counts(docs) + 0.5
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return json.dumps({"transitions": np.round(logs, 2).tolist(), "words": dictionary(docs)})


def _covered(value: str, words: dict[str, tuple[int, ...]]) -> float:
    """Share of the letters that dictionary words cover, the longest first from the left on."""
    low, at, inside = value.lower(), 0, 0
    while at <= len(low) - 4:
        for size in words.get("^" + low[at : at + 4], ()):
            if low[at : at + size] in words:
                inside, at = inside + size, at + size
                break
        else:
            at += 1
    return inside / len(low)


def features_of(text: str, start: int, end: int, model: tuple[np.ndarray, dict[str, tuple[int, ...]]]) -> list[float]:
    """Features of the candidate ``text[start:end]``."""
    logs, words = model
    value = text[start:end]
    n = len(value)
    s = _symbols(value.encode("utf-8", "replace"))
    steps = logs[s[:-1], s[1:]] if len(s) > 1 else np.zeros(1)
    counts = np.bincount(s, minlength=ALPHABET)
    shares = counts[counts > 0] / len(s)
    kinds = np.select([(s >= 48) & (s < 58), (s >= 65) & (s < 91), (s >= 97) & (s < 123)], [0, 1, 2], 3)
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = [0.0] * BUCKETS
    for word in NEIGHBOURS.findall(left)[-4:]:
        near[sum(map(ord, word.lower())) % BUCKETS] += 1.0
    line = re.split(r"\s", left)[-1] + value + re.split(r"\s", right)[0]
    return [
        float(n),
        float(steps.mean()),
        float(steps.min()),
        float(-(shares * np.log2(shares)).sum()),
        float((kinds == 0).mean()),
        float((kinds == 1).mean()),
        float((kinds == 2).mean()),
        float((kinds == 3).mean()),
        float((np.diff(kinds) != 0).mean()) if len(kinds) > 1 else 0.0,
        _covered(value, words),
        float(line.count("/")),
        float("://" in line or "www." in line),
        float(bool(re.search(r"\.[a-z]{2,4}$", line))),
        float(bool(TELLING.search(left))),
        float(left.rstrip(" \"'").endswith(("=", ":"))),
        float(bool(re.fullmatch(r"[0-9a-fA-F-]+", value))),
        *near,
    ]


def candidates_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all candidates; of those that overlap, the most telling kind."""
    found: list[tuple[int, int, str]] = [(*m.span(), m.lastgroup) for m in KNOWN.finditer(text)]
    found += [(*m.span(1), "assigned") for m in ASSIGNED.finditer(text)]
    found += [(*m.span(), "code") for m in CODE.finditer(text)]
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for start, end, kind in found:
        if all(end <= a or b <= start for a, b in taken):
            out.append((start, end, kind))
            taken.append((start, end))
    return sorted(out)


def _format_label(value: str, kind: str) -> int:
    """What the format alone says: 1 secret, 0 harmless, -1 nothing."""
    if kind in FORMATS:
        return 1
    if HARMLESS.fullmatch(value):
        return 0
    mixed = len(set(value)) >= 8 and re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value)
    return 1 if kind == "assigned" and mixed else -1


FOUND = "start int, end int, kind string, value string, says int, features array<double>"


def _scan(blob: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(blob)
        for batch in batches:
            out: list[tuple] = [(i, r, *[None] * 6) for i, r in zip(batch["doc_id"].astype(object), batch["row"])]
            for number, text in zip(batch["row"], batch["text"]):
                for start, end, kind in candidates_of(text or ""):
                    value = text[start:end]
                    out.append((None, number, start, end, kind, value, _format_label(value, kind), features_of(text, start, end, model)))
            yield pd.DataFrame(out, columns=["doc_id", "row", "start", "end", "kind", "value", "says", "features"])

    return run


def findings(docs: DataFrame, labelled: DataFrame | None = None, most: int = FINDINGS) -> tuple[DataFrame, DataFrame]:
    """Numbered rows of ``docs`` (``doc_id, row``) and the candidates found in them, scored.

    ``labelled``: ``(doc_id, start, end, secret boolean)`` findings to learn from instead
    of what formats say. Candidates have ``row, start, end, kind, value, score``; places
    count code points and ends are exclusive. Null and empty texts have none, repeated rows
    each their own, null ids are fine. Without findings of both classes the score is 1 for
    what its format says is a secret, else 0.
    """
    blob = corpus_model(docs)
    # One pass writes rows and candidates, so that both have the same numbers.
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    both = work_table(numbered.mapInPandas(_scan(blob), f"doc_id {numbered.schema['doc_id'].dataType.simpleString()}, row long, {FOUND}"), "secret-candidates")
    rows = both.filter("kind is null").select("doc_id", "row")
    found = both.filter("kind is not null").drop("doc_id")
    if labelled is None:
        known = found.filter("says >= 0").select("features", F.col("says").cast("double").alias("label"), "row", "start")
    else:
        truth = labelled.select("doc_id", "start", "end", F.col("secret").cast("double").alias("label"))
        known = found.join(rows, "row").join(truth, ["doc_id", "start", "end"]).filter("label is not null").select("features", "label", "row", "start")
    known = work_table(known, "secret-known")
    n = known.count()
    share = min(1.0, most / n) if n else 1.0
    known = known.filter(F.pmod(F.xxhash64("row", "start"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = known.select(array_to_vector("features").alias("features"), "label").repartition(4).persist()
    classes = {r["label"] for r in sample.select("label").distinct().collect()}
    if classes != {0.0, 1.0}:
        scored = found.withColumn("score", (F.col("says") == 1).cast("double"))
    else:
        forest = RandomForestClassifier(numTrees=30, maxDepth=8, minInstancesPerNode=3, seed=5).fit(sample)
        seen = forest.transform(found.withColumn("features", array_to_vector("features")))
        scored = seen.withColumn("score", vector_to_array("probability")[1])
    sample.unpersist()
    return rows, scored.select("row", "start", "end", "kind", "value", "score")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, n_candidates, n_secrets, findings)`` per row of ``docs``.

    ``findings`` is an array of ``(start, end, kind, score)`` by start.
    """
    rows, found = findings(docs, labelled)
    secret = F.col("score") >= threshold
    each = found.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.array_sort(F.collect_list(F.when(secret, F.struct("start", "end", "kind", F.round("score", 4).alias("score"))))).alias("findings"),
    )
    met = rows.join(each, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    list_ = F.coalesce("findings", none)
    return met.select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.size(list_).cast("long").alias("n_secrets"),
        list_.alias("findings"),
    )


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(F.transform("findings", line), ",").alias("findings"))
