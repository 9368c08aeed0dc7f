"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: two logistic models, quality from the form of the text (symbols,
capitals, repeats, tables, length) and toxicity from words and word beginnings
whose odds among toxic documents are high. Both are fitted on a bounded sample: at
most about ``sample`` labelled documents, by a hash of the id.

Site evidence: the documents' probabilities are added up per host and per path in
it. A host's posterior shrinks towards the global mean, a path's towards its
host's; the prior strengths come from the data (method of moments over all hosts
and paths), so sparse sites lean on what is above them. A document's posterior
log-odds are its own plus ``WEIGHT`` times what its path differs from the global
mean, so a site shifts doubtful documents and overrules no clear one.

For tables without URLs the host is ``source`` and the path ``lang`` in it; nulls are
a host or path of their own. A null text counts as empty. Repeated rows stay. An
empty table gives an empty result; without labels of both classes a model says
nothing (quality 1, toxicity 0). Sums use every row of the input.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.llm.common import aside, materialise, table, trimmed

SAMPLE, WEIGHT = 20_000, 0.5
#: Word keys of the toxicity model: at most so many, each in so many toxic documents and with such log-odds.
KEYS, LEAST, ODDS = 5000, 5, 3.0
PREFIXES = (3, 4, 5)
#: Word keys that a task holds before it hands their counts on.
HELD = 150_000
#: Sites up to which posteriors are broadcast (some 100 bytes each); beyond, they are joined by shuffle with skew splitting.
SITES = 100_000
#: Working columns; columns of these names in the input are set aside.
TAKEN = {f"{p}{c}" for c in ("_quality", "_toxic") for p in ("", "p", "n")} | {"_host", "_path", "_keep"}
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
SYMBOLS = b"#$%&*+=<>@\\^_`~{}[]"
DIGITS = b"0123456789"
EDGES = ".,;:!?\"'()[]{}<>|*#$%&+-=_/\\~`@^"


def form(text: str) -> list[float]:
    """What a text looks like, whatever its language."""
    words, lines, data = text.split(), text.split("\n"), text.encode("utf-8", "surrogatepass")
    n = max(1, len(words))
    count = lambda chars: len(data) - len(data.translate(None, chars))
    distinct = len(set(words)) / n
    return [
        min(5.0, count(SYMBOLS) / n),
        min(3.0, count(b"!") / n),
        min(3.0, count(b"|") / n),
        count(UPPER) / max(1, count(LETTERS)),
        1 - distinct,
        distinct * n**0.25,
        sum(map(eq, words, words[1:])) / n,
        count(DIGITS) / max(1, len(data)),
        math.log1p(len(words)),
        min(20.0, len(data) / n),
        1 - len(set(lines)) / len(lines),
    ]


FORM = 11


def words_of(text: str) -> set[str]:
    return {w.strip(EDGES) for w in set(text.lower().split())}


def keys_of(word: str) -> list[str]:
    return [word] + [f"{word[:k]}-" for k in PREFIXES if len(word) >= k]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> dict | None:
    """Weights by Newton steps on standardised features and their squares; None without both classes."""
    if len(y) < 2 or y.min() == y.max():
        return None
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / std, -6, 6)
    z = np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w / math.sqrt(len(y))
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge / math.sqrt(len(y)) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "std": std, "w": w}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["std"], -6, 6)
    return 1 / (1 + np.exp(-np.clip(np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1) @ model["w"], -15, 15)))


def word_counts(batches):
    """In how many toxic and other sample documents each word key occurs; counts of a key may come in parts."""
    toxic, other = Counter(), Counter()

    def flush():
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([other[k] for k in names], pa.int64())], names=["k", "t", "o"])
        toxic.clear()
        other.clear()

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update({k for w in words_of(text) if w for k in keys_of(w)})
            if len(toxic) + len(other) > HELD:
                yield from flush()
    yield from flush()


def toxic_form(text: str, odds: dict[str, float], starts: frozenset[str]) -> list[float]:
    words = words_of(text)
    hits = [max((odds[k] for k in keys_of(w) if k in odds), default=0.0) for w in words if w[:3] in starts]
    hits = [h for h in hits if h]
    return [float(bool(hits)), math.log1p(len(hits)), math.log1p(sum(hits)), len(hits) / max(1, len(words)) * 10]


def starts_of(odds: dict[str, float]) -> frozenset[str]:
    return frozenset(k.removesuffix("-")[:3] for k in odds)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """Models of quality and toxicity from ``labels`` (key, quality, toxic)."""
    total = labels.count()
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # One row for each id, so the sample has about ``sample`` rows of a few bytes: a proven bound for the broadcast.
    marks = F.min("quality").alias("_q"), F.max("toxic").alias("_t")
    own = labels.where(chance < sample / max(total, sample)).groupBy(F.col(key).alias("_key")).agg(*marks)
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(own), F.col("_id") == F.col("_key"))
    # Repeated rows of a document are one example; they collapse before the exchange.
    rows = rows.groupBy("_key", "text").agg(F.min("_q").alias("quality"), F.max("_t").alias("toxic")).select("text", "quality", "toxic")
    rows = materialise(rows, "labelled")
    marked = rows.where(F.col("toxic").isNotNull())
    n = {r["toxic"]: r["count"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    odds: dict[str, float] = {}
    if n.get(1) and n.get(0):
        counts = marked.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(trimmed(word_counts), "k string, t bigint, o bigint").groupBy("k").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        weight = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("o") + 0.5) / (n[0] + 1))
        found = counts.where(F.col("t") >= LEAST).withColumn("w", weight).where(F.col("w") >= ODDS).orderBy(F.col("t").desc(), "k").limit(KEYS).collect()
        odds = {r["k"]: r["w"] for r in found}
    starts = starts_of(odds)

    def features(batches):
        for batch in batches:
            got = [form(t) + toxic_form(t, odds, starts) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), batch.column(2).cast(pa.float64()), pa.array(got, pa.list_(pa.float64()))], names=["q", "t", "x"])

    data = rows.select("text", F.col("quality").cast("double"), F.col("toxic").cast("double")).mapInArrow(features, "q double, t double, x array<double>").collect()  # the bounded sample's numbers
    x = np.array([r["x"] for r in data]).reshape(-1, FORM + 4)
    q, t = (np.array([np.nan if r[c] is None else r[c] for r in data]) for c in ("q", "t"))
    has_q, has_t = ~np.isnan(q), ~np.isnan(t)
    return {"quality": fit_logistic(x[has_q, :FORM], (q[has_q] > 0).astype(float)), "toxic": fit_logistic(x[has_t, FORM:], (t[has_t] > 0).astype(float)), "odds": odds}


def scorer(model: dict, at: int):
    """Append the probabilities of quality and toxicity to each row; ``at``: the text's column."""

    def run(batches):
        odds, starts = model["odds"], starts_of(model["odds"])
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n = len(texts)
            quality = predict(model["quality"], np.array([form(t) for t in texts]).reshape(-1, FORM)) if model["quality"] else np.ones(n)
            toxic = predict(model["toxic"], np.array([toxic_form(t, odds, starts) for t in texts]).reshape(-1, 4)) if model["toxic"] else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality), pa.array(toxic)], names=[*batch.schema.names, "_quality", "_toxic"])

    return run


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with the document classifiers' probabilities ``_quality`` and ``_toxic``."""
    schema = T.StructType([*df.schema.fields, T.StructField("_quality", T.DoubleType()), T.StructField("_toxic", T.DoubleType())])
    return df.mapInArrow(trimmed(scorer(model, df.columns.index(text))), schema)


def sites(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, dict]:
    """Posteriors of each (host, path), shrunk to its host's and the global mean, and the global means."""
    names = ("_quality", "_toxic")
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s{c}") for c in names]
    paths = materialise(scored.groupBy(F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path")).agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("n", "s_quality", "s_toxic")])
    total = hosts.agg(*[F.sum(c).alias(c) for c in ("n", "s_quality", "s_toxic")]).first()
    n = max(total["n"] or 0, 1)
    mean = {c: min(1 - 1e-3, max(1e-3, (total[f"s{c}"] or 0.0) / n)) for c in names}

    def strength(of: DataFrame, centre, c: str) -> float:
        """Prior strength by moments: how far site means spread beyond what their sizes explain."""
        rate = F.col(f"s{c}") / F.col("n")
        r = of.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (rate - centre) ** 2).alias("between")).first()
        inner = mean[c] * (1 - mean[c])
        between = ((r["between"] or 0.0) - inner * (r["k"] or 0)) / max(r["n"] or 1, 1)
        return min(1e6, max(2.0, inner / max(between, 1e-9)))

    post = hosts
    for c in names:
        k = strength(hosts, F.lit(mean[c]), c)
        post = post.withColumn(f"h{c}", (F.col(f"s{c}") + k * mean[c]) / (F.col("n") + k))
    both = paths.join(post.select("_host", "h_quality", "h_toxic"), paths["_host"].eqNullSafe(post["_host"])).drop(post["_host"])
    both = materialise(both, "sites")
    out = both
    for c in names:
        k = strength(both, F.col(f"h{c}"), c)
        out = out.withColumn(f"p{c}", (F.col(f"s{c}") + k * F.col(f"h{c}")) / (F.col("n") + k))
    return out.select("_host", "_path", "p_quality", "p_toxic"), mean


def logit(x):
    return F.log(x / (1 - x))


def posterior(scored: DataFrame, site: DataFrame, mean: dict, host: str, path: str) -> DataFrame:
    """``scored`` with ``_quality``, ``_toxic`` now posterior probabilities, and ``_keep``."""
    if site.count() <= SITES:
        site = F.broadcast(site)
    joined = scored.join(site, scored[host].cast("string").eqNullSafe(site["_host"]) & scored[path].cast("string").eqNullSafe(site["_path"]), "left")
    edge = lambda x: F.least(F.greatest(x, F.lit(1e-3)), F.lit(1 - 1e-3))
    for c in ("_quality", "_toxic"):
        moved = logit(F.least(F.greatest(F.col(c), F.lit(1e-7)), F.lit(1 - 1e-7))) + WEIGHT * (logit(edge(F.coalesce(F.col(f"p{c}"), F.lit(mean[c])))) - math.log(mean[c] / (1 - mean[c])))
        joined = joined.withColumn(f"n{c}", 1 / (1 + F.exp(-moved)))
    return joined.select(*[c for c in scored.columns if c not in ("_quality", "_toxic")], F.col("n_quality").alias("_quality"), F.col("n_toxic").alias("_toxic"), ((F.col("n_quality") >= 0.5) & (F.col("n_toxic") < 0.5)).alias("_keep"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without their texts, with ``quality``, ``toxic`` and ``keep``; columns of these names are replaced."""
    model = fit(docs, labels, sample=sample)
    docs, back = aside(docs, TAKEN)
    scored = materialise(score(docs, model).drop("text"), "scored")
    out = posterior(scored, *sites(scored, host, path), host, path)
    return out.drop("quality", "toxic", "keep").withColumnsRenamed({"_quality": "quality", "_toxic": "toxic", "_keep": "keep"} | back)


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are to keep. Scored rows are written, since scoring costs far more than that."""
    model = fit(docs, labels, sample=sample)
    names = docs.columns
    docs, back = aside(docs, TAKEN)
    scored = materialise(score(docs, model), "scored")
    out = posterior(scored, *sites(scored, host, path), host, path)
    return out.where("_keep").select(*docs.columns).withColumnsRenamed(back).select(*names)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "source", "quality", "toxic", "keep")
