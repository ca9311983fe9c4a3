"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import WORD, keep, sent

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its share of the tokens to this power, scaled to 1.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Raking ends where a whole round scales no category by more than this; or where, for STALLED rounds, the largest scaling
#: hasn't come 0.1 % nearer to none: then the targets contradict each other.
TOLERANCE, STALLED = 1e-6, 5
#: Rounds that the SQL has at most; those after the settled one change nothing.
SQL_ROUNDS = 40
UNKNOWN = "(none)"
#: Topics are told by so many terms: the most widespread plain words that at most this share of all documents have, but LEAST_DOCS of them.
TERMS, COMMON, LEAST_DOCS = 256, 0.05, 2
TERM = "[a-z]{5,20}"
#: Terms fall into so many clusters by their hash, terms of all languages in each: the topics.
CLUSTERS = 8


def words_of(text: str = "text") -> Column:
    """The words of a text, those of WORD: it is split at single blanks once all white space is one."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", " " * 5), " "), "")


def topic_terms(docs: DataFrame) -> list[str]:
    """The TERMS terms by which topics of ``docs`` (text) are told, the most widespread first, ties by name.

    All documents count: each names its different words, and a word's documents are summed in each task first."""
    words = docs.select(F.explode(F.array_distinct(words_of())).alias("w")).where(F.col("w").rlike(f"^{TERM}$"))
    df = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    most = docs.count() * COMMON
    return [r.w for r in df.where(F.col("n") <= most).orderBy(F.desc("n"), "w").limit(TERMS).collect()]


def with_topic(docs: DataFrame, terms: list[str], name: str = "topic") -> DataFrame:
    """``docs`` (text) with _words and the cluster that most of a text's different ``terms`` fall into, of equal ones the first; UNKNOWN where it has none.

    Each step is a column that the next one names more than once, so that none is worked out again within another."""
    of = lambda c: lambda w: w == c
    cluster = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % CLUSTERS
    worded = docs.withColumn("_words", words_of())
    if not terms:
        return worded.withColumn(name, F.lit(UNKNOWN))
    found = worded.withColumn("_found", F.transform(F.array_intersect(F.array(*[F.lit(t) for t in terms]), "_words"), cluster))
    times = found.withColumn("_times", F.array(*[F.size(F.filter("_found", of(c))) for c in range(CLUSTERS)])).drop("_found")
    most = F.array_max("_times")
    return times.withColumn(name, F.when(most > 0, F.concat(F.lit("cluster"), (F.array_position("_times", most) - 1).cast("string"))).otherwise(F.lit(UNKNOWN))).drop("_times")


def with_cells(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, source, lang, topic and tokens (words, one at least) of each row; null categories become UNKNOWN."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in ("source", "lang")]
    told = with_topic(docs.select("doc_id", *named, "text"), terms)
    return told.select("doc_id", "source", "lang", "topic", F.greatest(F.size("_words"), F.lit(1)).cast("long").alias("tokens"))


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(dimension, target): what the tokens of each category should come to, the total unchanged."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("own"))
    whole = own.agg(F.sum(F.pow(F.col("own").cast("double"), F.lit(power))).alias("p")).select("p").scalar()
    total = own.agg(F.sum("own").alias("t")).select("t").scalar()
    return own.select(dimension, (F.pow(F.col("own").cast("double"), F.lit(power)) / whole * total).alias("target"))


def beside_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    held = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        held = held.join(target.withColumnRenamed("target", f"target_{d}"), d, "left")
    return keep(held, "cells")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (categories, tokens) with the weight of each cell's tokens and ``ratio`` = weight / tokens, raked until all marginals meet their targets.

    A round scales the cells of every category to its target, one dimension after the other. The targets stand
    beside the cells from the start; marginals are pre-aggregated sums joined back by category, never a window over
    a category's cells. A round ends in a kept table, so that no plan holds more than one. The cells carry the
    largest scaling of the round. A category without a target keeps its weight. Targets that
    no weights can meet together (where some cells are missing) leave an error, which is logged: the last
    dimension then meets its targets and the others come as near as their last scaling says (see errors)."""
    held = beside_targets(cells, targets)
    least, stalled = float("inf"), 0
    while stalled < STALLED:
        held = held.withColumn("moved", F.lit(0.0))
        for d in targets:
            own = held.groupBy(d).agg(F.sum("weight").alias("own"))
            factor = F.coalesce(F.col(f"target_{d}") / F.col("own"), F.lit(1.0))
            held = held.join(own, d).withColumns({"weight": F.col("weight") * factor, "moved": F.greatest("moved", F.abs(factor - 1))}).drop("own")
        held = keep(held, "raked")
        moved = held.agg(F.max("moved")).first()[0] or 0.0
        if moved <= tolerance:
            break
        stalled = 0 if moved < 0.999 * least else stalled + 1
        least = min(least, moved)
    else:
        logging.getLogger(__name__).warning("targets contradict each other: marginals are still scaled by up to %.6g", moved)
    return held.drop("moved", *[f"target_{d}" for d in targets]).withColumn("ratio", F.col("weight") / F.col("tokens"))


def errors(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, category, weight, target, error): how far each marginal of ``raked`` is from its target, as a share of it."""
    out = None
    for d, target in targets.items():
        own = raked.groupBy(d).agg(F.sum("weight").alias("weight")).join(target, d).select(F.lit(d).alias("dimension"), F.col(d).alias("category"), "weight", "target", (F.col("weight") / F.col("target") - 1).alias("error"))
        out = own if out is None else out.unionByName(own)
    return out


def uniform(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) that the id and the seed settle; rows of one id share it."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = "mix", temper: dict[str, float] = TEMPER) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and sampled for each row of ``docs`` (doc_id, text, source, lang).

    Token weights are raked to tempered marginals of source, language and topic, which is the cluster that most of a text's
    topic terms fall into. A document's probability is its cell's ratio over the largest of all, so that sampled tokens keep the raked
    proportions; it is sampled where its id's uniform number lies below. Null texts count one token,
    null categories are one of their own, an empty table gives no rows, rows of one id fare alike."""
    counted = keep(with_cells(docs, topic_terms(docs)), "counted")
    return counted.join(sent(calibrated(counted, temper)), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", "probability", (uniform("doc_id", seed) < F.col("probability")).alias("sampled"))


def calibrated(counted: DataFrame, temper: dict[str, float] = TEMPER) -> DataFrame:
    """A kept table (source, lang, topic, probability) of the cells of ``counted`` (see with_cells)."""
    cells = keep(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "tokens")
    raked = rake(cells, {d: tempered_targets(cells, d, temper[d]) for d in DIMENSIONS})
    top = raked.agg(F.max("ratio").alias("top")).select("top").scalar()
    return keep(raked.select(*DIMENSIONS, F.round(F.col("ratio") / top, 6).alias("probability")), "probabilities")


def sample(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The sampled rows of ``docs``, all columns (see mix).

    Rows are written once beside their cell, so that each text is split twice in all, for the terms and for its topic, and
    no filter on the cell works it out again."""
    own = {f"_own_{c}": F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("source", "lang")}
    told = with_topic(docs, topic_terms(docs), "_own_topic").withColumns(own | {"_own_tokens": F.greatest(F.size("_words"), F.lit(1)).cast("long")}).drop("_words")
    told = keep(told, "told")
    share = calibrated(told.select(*[F.col(f"_own_{c}").alias(c) for c in DIMENSIONS], F.col("_own_tokens").alias("tokens")))
    share = sent(share.select(*[F.col(c).alias(f"_own_{c}") for c in DIMENSIONS], F.col("probability").alias("_own_probability")))
    return told.join(share, [f"_own_{c}" for c in DIMENSIONS]).where(uniform("doc_id", seed) < F.col("_own_probability")).select(*docs.columns)


def mix_sql(seed: str = "mix", rounds: int = SQL_ROUNDS, temper: dict[str, float] = TEMPER, docs: str = "documents") -> tuple[list[str], str]:
    """(common table expressions, select) of the same rows in DuckDB."""
    parts = [
        f"worded as materialized (select doc_id, source, lang, regexp_extract_all(coalesce(text,''), '{WORD}') w from {docs})",
        f"terms as materialized (select coalesce(list(t order by n desc, t), []) a from (select t, count(*) n from (select unnest(list_distinct(w)) t from worded) where regexp_full_match(t, '{TERM}') group by t having count(*) >= {LEAST_DOCS} and count(*) <= {COMMON} * (select count(*) from {docs}) order by n desc, t limit {TERMS}))",
        f"hit as materialized (select doc_id, source, lang, w, list_transform(list_filter(a, lambda x: list_contains(w, x)), lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % {CLUSTERS}) c from worded, terms)",
        f"counted as materialized (select doc_id, coalesce(source, '{UNKNOWN}') source, coalesce(lang, '{UNKNOWN}') lang, case when len(c) > 0 then 'cluster' || (list_position(times, list_max(times)) - 1) else '{UNKNOWN}' end topic, greatest(len(w), 1)::bigint tokens from (select *, list_transform(range({CLUSTERS}), lambda t: len(list_filter(c, lambda x: x = t))) times from hit))",
        "cells as (select source, lang, topic, sum(tokens)::double tokens, sum(tokens)::double weight, 0e0 moved, false settled from counted group by all)",
    ]
    for d in DIMENSIONS:
        parts.append(f"own_{d} as (select {d}, sum(tokens) own from cells group by all)")
        parts.append(f"target_{d} as (select {d}, pow(own, {temper[d]}) / (select sum(pow(own, {temper[d]})) from own_{d}) * (select sum(own) from own_{d}) target from own_{d})")
    before = "cells"
    for r in range(rounds):
        for d in DIMENSIONS:
            now = f"w{r}_{d}"
            parts.append(f"{now} as materialized (select source, lang, topic, tokens, weight * f weight, greatest(moved, abs(f - 1)) moved, settled from (select c.*, case when settled then 1e0 else target / sum(weight) over (partition by c.{d}) end f from {before} c join target_{d} t on t.{d} = c.{d}))")
            before = now
        parts.append(f"w{r} as materialized (select source, lang, topic, tokens, weight, 0e0 moved, settled or max(moved) over () <= {TOLERANCE!r} settled from {before})")
        before = f"w{r}"
    parts.append(f"share as (select source, lang, topic, round(weight / tokens / (select max(weight / tokens) from {before}), 6) probability from {before})")
    u = f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(1 << 52)!r})"
    return parts, f"select doc_id, source, lang, topic, tokens, probability, {u} < probability sampled from counted join share using (source, lang, topic)"
