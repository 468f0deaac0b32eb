"""Mixing to target weights: iterative proportional fitting of token weights, then sampling with calibrated odds.

Tokens are summed for every cell of the margins' values. Sweeps scale the cells' weights to each margin's target shares
in turn. A document's probability is its cell's weight times one factor, 1 at most; the factor is such that the wanted
share of all tokens is expected. Cells below 1 keep the fitted proportions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import table

#: Sweeps over all margins at most; they stop where no weight changes by more than TOLERANCE of itself.
SWEEPS, TOLERANCE = 12, 1e-13
#: Cells (not documents) that the fit holds on the driver and that are broadcast, about 10 MB; more are refused.
MOST_CELLS = 200_000
#: Letters whose most frequent one stands for a text's topic.
LETTERS = "tnsrhdlc"
#: A margin's target share is its present share to this power, scaled to 1: 1 keeps it, 0 makes all values alike.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Wanted share of all tokens.
SHARE = 0.5


def n_tokens(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Weights of cells whose weighted tokens have the target shares in every margin (the last margin exactly)."""
    weight = np.ones(len(tokens))
    total = tokens.sum()
    for _ in range(sweeps):
        before = weight
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights=weight * tokens, minlength=len(target))
            weight = weight * np.where(now > 0, target * total / np.where(now > 0, now, 1), 1.0)[code]
        if (np.abs(weight - before) <= TOLERANCE * before).all():
            break
    return weight


def scale(weight: np.ndarray, tokens: np.ndarray, share: float) -> float:
    """The factor with which min(1, factor * weight) of the tokens are the share of all: the heaviest cells that would
    exceed 1 are taken whole, the others share what is left."""
    own = (tokens > 0) & (weight > 0)
    order = np.argsort(-weight[own], kind="stable")
    w, t = weight[own][order], tokens[own][order]
    whole, mass = np.concatenate([[0], np.cumsum(t)]), np.concatenate([[0], np.cumsum(t * w)])
    for k in range(len(w)):
        factor = (share * tokens.sum() - whole[k]) / (mass[-1] - mass[k])
        if factor * w[k] <= 1:
            return max(factor, 0.0)
    return 1 / w[-1] if len(w) else 0.0


def mixed(docs: DataFrame, margins: dict[str, float] | None = None, share: float = SHARE, seed: str = "mix",
    targets: dict[str, dict] | None = None) -> DataFrame:
    """The columns of docs with n_tokens, probability and sampled; one row for each row of docs.

    margins names columns and the powers that flatten them; targets may give a margin's shares outright (values it does
    not name get none). Null is a value of a margin like any other. Texts without words count no tokens and share their
    cell's probability. A row is sampled where a number from the md5 of seed and doc_id is below its probability, so
    rows that repeat a doc_id go together; a null doc_id counts as empty text. An empty table gives no rows. Columns of
    docs named n_tokens, probability or sampled are replaced.
    """
    margins = margins or FLATTEN
    docs = docs.drop("probability", "sampled").withColumn("n_tokens", n_tokens(F.col("text").cast("string")))
    names = list(margins)
    cells = docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    rows = cells.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"the margins have over {MOST_CELLS} cells; use coarser ones")
    rows = sorted(rows, key=lambda r: tuple(("" if r[n] is None else f"={r[n]}") for n in names))
    tokens = np.array([r["tokens"] for r in rows], dtype=np.float64)
    codes, shares = [], []
    for n in names:
        values = {v: i for i, v in enumerate(dict.fromkeys(r[n] for r in rows))}
        code = np.array([values[r[n]] for r in rows], dtype=np.int64)
        now = np.bincount(code, weights=tokens, minlength=len(values))
        given = (targets or {}).get(n)
        want = np.array([given.get(v, 0.0) for v in values]) if given else (now / max(now.sum(), 1)) ** margins[n] * (now > 0)
        codes.append(code)
        shares.append(want / want.sum() if want.sum() else want)
    weight = rake(tokens, codes, shares) if len(rows) else tokens
    factor = scale(weight, tokens, share)
    spark = docs.sparkSession
    kinds = ", ".join(f"__mix{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    fitted = spark.createDataFrame([(*(r[n] for n in names), float(min(1.0, w * factor))) for r, w in zip(rows,
        weight, strict=True)], f"{kinds}, probability double")
    on = [docs[n].eqNullSafe(fitted[f"__mix{i}"]) for i, n in enumerate(names)]
    out = docs.join(F.broadcast(fitted), on, "left").drop(*[f"__mix{i}" for i in range(len(names))])  # MOST_CELLS rows at most
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        1, 12), 16, 10).cast("double") / float(1 << 48)
    return out.withColumn("sampled", u < F.col("probability"))


def _topics(texts: pd.Series) -> pd.Series:
    low, high = (np.frombuffer(x.encode(), dtype=np.uint8) for x in (LETTERS, LETTERS.upper()))
    out = []
    for text in texts:
        n = np.bincount(np.frombuffer((text or "").encode(), dtype=np.uint8), minlength=256)
        n = n[low] + n[high]
        out.append(int(n.argmax()) if n.any() else -1)
    return pd.Series(out, dtype="int32")


def with_topic(docs: DataFrame) -> DataFrame:
    """docs with a topic, as the tables have none: the place in LETTERS of the letter that the whole text has most often
    (the first of equal ones); -1 for a text without any and for none. All letters are counted in one pass over a
    text's bytes, in Arrow batches; an expression for each letter takes eight passes."""
    return docs.withColumn("topic", F.pandas_udf(_topics, "int")(F.col("text").cast("string")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_topic(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def _op8_sql() -> str:
    counts = [f"len(text) - len(translate(text, '{v}{v.upper()}', ''))" for v in LETTERS]
    topic = f"CASE WHEN coalesce(greatest({', '.join(counts)}), 0) = 0 THEN -1 " + " ".join(f"WHEN {n} = greatest({', '.join(counts)}) THEN {i}" for i,
        n in enumerate(counts)) + " END"
    steps = [f"""docs AS (SELECT doc_id, source, lang, CAST({topic} AS INTEGER) AS topic,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
      "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t, CAST(1 AS DOUBLE) AS w FROM docs GROUP BY ALL)",
          "total AS (SELECT sum(t) AS n FROM c0)"]
    for name, power in FLATTEN.items():
        steps.append(f"t_{name} AS (SELECT {name}, pow(sum(t) / (SELECT n FROM total), {power}) AS raw FROM c0 GROUP BY {name})")
        steps.append(f"s_{name} AS (SELECT {name}, raw / (SELECT sum(raw) FROM t_{name}) AS share FROM t_{name})")
    k = 0
    for _ in range(SWEEPS):
        for name in FLATTEN:
            steps.append(f"n{k + 1} AS MATERIALIZED (SELECT {name}, sum(w * t) AS now FROM c{k} GROUP BY {name})")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, CASE WHEN n.now > 0 THEN c.w * "
                f"s.share * (SELECT n FROM total) / n.now ELSE c.w END AS w FROM c{k} c JOIN n{k + 1} n ON c.{name} IS NOT "
                f"DISTINCT FROM n.{name} JOIN s_{name} s ON c.{name} IS NOT DISTINCT FROM s.{name})")
            k += 1
    steps.append(f"r AS (SELECT w, t, sum(t) OVER o - t AS whole, sum(w * t) OVER o - w * t AS mass, row_number() OVER o AS k "
        f"FROM c{k} WHERE t > 0 AND w > 0 WINDOW o AS (ORDER BY w DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))")
    steps.append(f"g AS (SELECT k, w, ({SHARE} * (SELECT n FROM total) - whole) / ((SELECT sum(w * t) FROM r) - mass) AS factor FROM r)")
    steps.append("f AS (SELECT coalesce((SELECT arg_min(factor, k) FROM g WHERE factor * w <= 1), (SELECT 1 / min(w) FROM r)) AS factor)")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(least(1, c.w * f.factor), 9) AS probability,
      CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < least(1, c.w * f.factor) AS sampled
    FROM docs d JOIN c{k} c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic, f"""


OP8_SQL = _op8_sql()
