"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells to the target of
one marginal after another until all hold, which changes the proportions within a marginal as
little as the targets allow. A cell's fitted weight over its tokens, divided by the largest
such ratio, is the probability with which its documents are kept: the expected tokens of
what stays have the target shares in every marginal.

Rows are reduced to cells before any shuffle, so a hot source is a few rows. A round's marginals are
window sums over the cells; a few rounds make one written table, so no plan grows with their number. A draw is a
hash of the id, the same in any layout.

Null source, language or topic is a value of its own; null or empty text has no tokens and is
kept with the probability of its cell (a cell without tokens: 1). Rows with one id share a
draw. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.tables import written

DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The kind of text, by the first mark that it holds."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!!")), "shout")
        .when(F.contains(F.lower(text), F.lit("licen")), "notice").when(F.contains(text, F.lit("\n")), "paragraphs").otherwise("line")
    )


def draw(key: Column, seed: str) -> Column:
    """Uniform in [0, 1), from the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_targets(cells: DataFrame, wanted: dict[str, float | dict[str, float]]) -> DataFrame:
    """``cells`` with ``_goal_<dim>``, the tokens wanted of a cell's value in each marginal (null for values without tokens).

    A number tempers: shares go as that power of the tokens. A dict names shares; values that it
    leaves out divide the rest by their tokens.
    """
    out, sums = cells, []
    for d, w in wanted.items():
        own = f"_t_{d}"
        # of the cells of one value one stands for it in sums over values
        out = out.withColumn(own, F.sum("tokens").over(Window.partitionBy(d))).withColumn(f"_one_{d}", F.row_number().over(Window.partitionBy(d).orderBy(*DIMS)) == 1)
        t = F.when(F.col(f"_one_{d}") & (F.col(own) > 0), F.col(own).cast("double"))
        if isinstance(w, dict):
            named = _named(d, w)
            sums += [F.sum(F.when(t.isNotNull(), named)), F.sum(F.when(named.isNull(), t))]
        else:
            sums += [F.sum(F.pow(t, F.lit(float(w)))), F.lit(0.0)]
    out = written(out)
    total, *parts = out.agg(F.sum("tokens"), *sums).first()
    for n, (d, w) in enumerate(wanted.items()):
        first, rest = parts[2 * n] or 0.0, parts[2 * n + 1] or 0.0
        t = F.when(F.col(f"_t_{d}") > 0, F.col(f"_t_{d}").cast("double"))
        if isinstance(w, dict):
            room = max(1.0 - first, 0.0) if rest else 0.0
            share = F.when(t.isNotNull(), F.coalesce(_named(d, w), F.lit(room) * t / F.lit(rest or 1.0)))
            goal = F.lit(float(total or 0)) * share / F.lit((first + room) or 1.0)
        else:
            goal = F.lit(float(total or 0)) * F.pow(t, F.lit(float(w))) / F.lit(first or 1.0)
        out = out.withColumn(f"_goal_{d}", goal)
    return out.select(*cells.columns, *[f"_goal_{d}" for d in wanted])


def _named(dim: str, shares: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])[F.coalesce(F.col(dim), F.lit(""))] if shares else F.lit(None).cast("double")


#: rounds whose plans are one job; the fit is looked at after each job
ROUNDS = 4
#: a job that closes less than this share of the gap says that the targets cannot all be met
STALL = 0.1


def rake(cells: DataFrame, wanted: dict[str, float | dict[str, float]], *, tolerance: float = 1e-10) -> tuple[DataFrame, float]:
    """``cells`` with the fitted ``weight``, and the largest relative miss of a marginal in the last round.

    Rounds go on until every marginal is met to ``tolerance``. Targets that the cells cannot meet together (a language that one
    source alone has, with unequal shares) make the miss settle above it: then rounds end, with a warning.
    """
    cells = written(with_targets(cells, wanted).withColumn("weight", F.col("tokens").cast("double")))
    names, miss = [c for c in cells.columns if c != "weight"], None
    while True:
        weight = "weight"
        for r in range(ROUNDS):
            gaps = []
            for d in wanted:
                have = F.sum(weight).over(Window.partitionBy(d))
                cells = cells.withColumn("_f", F.coalesce(F.col(f"_goal_{d}") / F.when(have > 0, have), F.lit(1.0)))
                cells = cells.withColumn(weight, F.col(weight) * F.col("_f"))
                if r == ROUNDS - 1:
                    cells = cells.withColumn(f"_gap_{d}", F.abs(F.col("_f") - 1))
                    gaps.append(F.col(f"_gap_{d}"))
        cells = written(cells.select(*names, "weight", (F.greatest(*gaps) if len(gaps) > 1 else gaps[0] if gaps else F.lit(0.0)).alias("_gap")))
        now = cells.agg(F.max("_gap")).first()[0] or 0.0
        cells = cells.drop("_gap")
        if now <= tolerance:
            break
        if miss is not None and now > miss * (1 - STALL):
            warnings.warn(f"the targets cannot all be met: a marginal misses its own by {now:.3g} of it", stacklevel=2)
            break
        miss = now
    return cells.drop(*[f"_goal_{d}" for d in wanted]), now


def _cells(docs: DataFrame, id_col: str, text_col: str, topic: Column | None) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (topic if topic is not None else topic_of(text)).alias("topic"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    )


def probabilities(rows: DataFrame, wanted: dict[str, float | dict[str, float]]) -> DataFrame:
    """(_source, _lang, _topic, probability) of each cell of the rows."""
    cells, _ = rake(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), wanted)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    top = cells.agg(F.max(rate)).first()[0]
    share = rate / F.lit(top) if top else F.lit(None).cast("double")
    return cells.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.coalesce(share, F.lit(1.0)).alias("probability"))


def _same(source: Column, lang: Column, topic: Column) -> Column:
    return source.eqNullSafe(F.col("_source")) & lang.eqNullSafe(F.col("_lang")) & topic.eqNullSafe(F.col("_topic"))


def mix(
    docs: DataFrame, wanted: dict[str, float | dict[str, float]], *, id_col: str = "doc_id", text_col: str = "text",
    topic: Column | None = None, seed: str = "mix",
) -> DataFrame:
    """id, source, lang, topic, tokens, probability, draw and kept for each row."""
    rows = written(_cells(docs, id_col, text_col, topic))
    rates = probabilities(rows, wanted)
    out = rows.join(rates, _same(F.col("source"), F.col("lang"), F.col("topic"))).withColumn("draw", draw(F.col("doc_id"), seed))
    return out.select("doc_id", *DIMS, "tokens", "probability", "draw", (F.col("draw") < F.col("probability")).alias("kept"))


def sampled(
    docs: DataFrame, wanted: dict[str, float | dict[str, float]], *, id_col: str = "doc_id", text_col: str = "text",
    topic: Column | None = None, seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with their own columns."""
    rates = written(probabilities(_cells(docs, id_col, text_col, topic), wanted))
    kind = topic if topic is not None else topic_of(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("all"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"), kind.alias("k"), draw(F.col(id_col), seed).alias("u"))
    return rows.join(rates, _same(F.col("s"), F.col("l"), F.col("k"))).filter(F.col("u") < F.col("probability")).select("all.*")


#: shares of sources, languages and topics go as this power of their tokens
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.9}


def mix_sql(rounds: int = 14) -> str:
    """The same fit in SQL, its rounds written out."""
    parts = [f"""
rows AS (SELECT doc_id, source, lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout' WHEN contains(lower(text), 'licen') THEN 'notice'
       WHEN contains(text, chr(10)) THEN 'paragraphs' ELSE 'line' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS weight FROM rows GROUP BY ALL)"]
    for d in DIMS:
        parts.append(f"""goal_{d} AS MATERIALIZED (SELECT {d} AS k, sum(t) OVER () * t ** {TEMPER[d]} / sum(t ** {TEMPER[d]}) OVER () AS target
  FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM c0 GROUP BY 1) WHERE t > 0)""")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * coalesce(target / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 1) AS weight
  FROM c{n} LEFT JOIN goal_{d} ON {d} IS NOT DISTINCT FROM k)""")
            n += 1
    parts.append(f"rates AS (SELECT source, lang, topic, coalesce((weight / nullif(tokens, 0)) / max(weight / nullif(tokens, 0)) OVER (), 1) AS p FROM c{n})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, r.source, r.lang, r.topic, tokens, round(p, 6) AS probability, u < p AS kept
FROM (SELECT *, ('0x' || substr(sha256('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM rows) r
JOIN rates q ON r.source IS NOT DISTINCT FROM q.source AND r.lang IS NOT DISTINCT FROM q.lang AND r.topic IS NOT DISTINCT FROM q.topic"""
