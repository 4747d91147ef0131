"""Secret scan: fixed patterns, then two character Markov models compared by their log-likelihood ratio.

One first-order model is trained on values that the fixed patterns found (random strings), the other on ordinary runs of letters.
Every unbroken run of ``MIN_RUN`` or more token characters outside the fixed spans is scored by the mean log-likelihood ratio of its
character steps; runs above ``threshold`` become spans of kind ``markov``.

Defined results: a NULL text counts as empty and has no spans; a document without spans has empty ``spans`` and the digest of the empty
string. Repeated rows are scanned each for itself. Without any labelled sample of one kind the ratio is zero and nothing is added.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import stored

# Kinds in their order of listing, pattern, group that holds the value, least length of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
RUN = r"[A-Za-z0-9+/_-]"
MIN_RUN = 20
SPAN = "array<struct<s:int,e:int,v:string>>"


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points, without those whose value is too short.

    Places come from the lengths of the pieces between matches, so one pass over the text gives all of them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(begin.alias("s"), end.alias("e"), x["value"].alias("v")))
        good = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _outside(runs: Column, taken: Column) -> Column:
    return F.filter(runs, lambda r: ~F.exists(taken, lambda t: (t["s"] < r["e"]) & (r["s"] < t["e"])))


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _steps(value: Column) -> Column:
    """Each pair of neighbouring characters as one number below 16384."""
    codes = _codes(value)
    size = F.size(codes) - 1
    pairs = F.zip_with(F.slice(codes, F.lit(1), size), F.slice(codes, F.lit(2), size), lambda a, b: a * 128 + b)
    return F.when(F.size(codes) > 1, pairs).otherwise(F.array().cast("array<int>"))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character step from two columns ``value``; counts are taken in Spark, at most 128 x 128 of each kind."""
    counts = (
        random.select(F.lit(1).alias("kind"), F.explode(_steps(F.col("value"))).alias("step"))
        .unionAll(ordinary.select(F.lit(0).alias("kind"), F.explode(_steps(F.col("value"))).alias("step")))
        .groupBy("kind", "step")
        .count()
        .collect()
    )
    tables = [[0] * 16384, [0] * 16384]
    for kind, step, n in counts:
        tables[kind][step] = n
    if not any(tables[0]) or not any(tables[1]):
        return [0.0] * 16384
    used = {c for t in tables for i, n in enumerate(t) if n for c in divmod(i, 128)}
    rows = [[sum(t[a * 128 : a * 128 + 128]) for a in range(128)] for t in tables]

    def log_step(kind: int, i: int) -> float:
        return math.log((tables[kind][i] + 0.5) / (rows[kind][i // 128] + 0.5 * len(used)))

    return [round(log_step(1, i) - log_step(0, i), 6) for i in range(16384)]


def scan_secrets(docs: DataFrame, sample_docs: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    ``sample_docs`` bounds the documents whose ordinary words train the second model (rows with the smallest hashes of their id, about
    that many); the first model learns from every value the patterns find.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        *[spans_of(F.col("text"), pattern, group, least).alias(kind) for kind, pattern, group, least in KINDS],
        spans_of(F.col("text"), RUN + "{%d,}" % MIN_RUN, 0, MIN_RUN).alias("run"),
    )
    kinds = [k for k, *_ in KINDS]
    found = stored(found.select("doc_id", *kinds, _outside(F.col("run"), F.concat(*kinds)).alias("run")), "secret-spans")
    random = found.select(F.explode(F.concat(*kinds)).alias("x")).select(F.regexp_replace("x.v", r"[^\x00-\x7F]", "").alias("value"))
    share = min(1.0, sample_docs / max(1, found.count()))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    ordinary = picked.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("value"))
    model = F.from_json(F.lit(json.dumps(train(random, ordinary))), "array<double>")

    def ratio(value: Column) -> Column:
        steps = _steps(value)
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.element_at(model, i + 1)) / F.size(steps)

    marked = found.withColumn("markov", F.filter("run", lambda r: ratio(r["v"]) > threshold))

    def entry(i: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

    def listed(names: list[tuple[int, str]]) -> Column:
        entries = [F.transform(F.col(k), entry(i)) for i, k in names]
        label = F.array(*[F.lit(k) for _, k in names])
        return F.array_join(
            F.transform(F.sort_array(F.concat(*entries)), lambda x: F.concat_ws(":", label[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ","
        )

    numbered = list(enumerate([*kinds, "markov"]))
    return marked.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(numbered[:-1]), 256).alias("base_sha256"),
        listed(numbered).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
