"""Language identification by hyperdimensional n-gram profiles.

Every letter code has a random bipolar vector. An n-gram binds its letters by
multiplication after rotating each by its position; a text or language bundles
(adds up) its n-grams, and a document takes the language whose prototype has the
highest cosine with its bundle. Since a bundle's inner product with a prototype
is the sum of its n-grams' inner products, each n-gram's product with every
prototype is computed once per worker, and a document's cosines are sums over
its letters divided by the prototypes' norms (the document's own norm is common
to all languages, so it drops out).

Prototypes are learned from text and language of all rows given. Prediction uses
the whole text and nothing else. ``und``: null texts and texts without letters;
their score is 0. Rows with a null language teach nothing. Repeated rows are rows
of their own; an empty table gives an empty result, and without any labelled row
every prediction is ``und``.

``kept`` judges by the evidence for the predicted language: the mean inner product of
the document's n-grams with its prototype, which does not depend on the length. A text
stays if that, plus ``NOISE`` standard errors of n-grams that have nothing to do with the
prototype, reaches ``FLOOR`` of the median of the learned documents of that language.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.llm.common import aside, table, trimmed

DIMS, GRAM = 2048, 3
#: Letter codes: 0 a gap, 1 to 26 a to z, other letters by their code point into the rest.
CODES = 128
#: Code points below this can be letters.
PLANES = 0x34000
#: Languages in a model; labels beyond that are an error rather than a silent cut.
LANGUAGES = 1000
#: Share of a language's median evidence that a text needs, and the allowance for few n-grams (a stray one has mean 0, deviation 1).
FLOOR, NOISE = 0.25, 2.5
#: Numbers of the table of n-gram products that a worker keeps (4 bytes each), whatever the number of languages.
KEPT = 32 << 20
_letters: np.ndarray | None = None
_products: dict = {}


def letter_table() -> np.ndarray:
    """Code of every code point, made from the rule above."""
    global _letters
    if _letters is None:
        t = np.zeros(PLANES, np.uint8)
        for cp in range(PLANES):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()[0]
                n = ord(low)
                t[cp] = n - 96 if "a" <= low <= "z" else 27 + (n * 2654435761 >> 7) % (CODES - 27)
        _letters = t
    return _letters


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all texts in turn, and how many each text has. A run of other characters is one gap."""
    codes = letter_table()[np.minimum(np.frombuffer("".join(f"\x00{t}\x00" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32), PLANES - 1)]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep].astype(np.int64), doc[keep]
    gram = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
    own = (doc[:-2] == doc[2:]) & (codes[1:-1] > 0)
    return gram[own], np.bincount(doc[1:-1][own], minlength=len(texts))


def vectors(grams: np.ndarray, seed: int = 7) -> np.ndarray:
    """Hypervectors of n-grams: rotated letter vectors, multiplied."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CODES, DIMS))
    out = base[grams % CODES]
    for k in range(1, GRAM):
        out = out * np.roll(base, k, axis=1)[grams // CODES**k % CODES]
    return out


#: Distinct n-grams that a task counts before they are bundled.
COUNTED = 1 << 19


def bundle(batches):
    """Prototype parts: per language, the sum of its n-grams' vectors. n-grams are counted first, so that each vector is made once for many."""
    place: dict[str, int] = {}
    sums, parts, held = {}, [], 0

    def fold(last: bool):
        """Counts of equal n-grams together; all into the sums, once they are many or at the end."""
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in parts]), len(keys))
        if not last and len(keys) < COUNTED:
            return [(keys, counts)], len(keys)
        for lang, k in place.items():
            own = slice(*np.searchsorted(keys, [k * CODES**GRAM, (k + 1) * CODES**GRAM]))
            for at in range(own.start, own.stop, 1024):
                these = slice(at, min(at + 1024, own.stop))
                sums[lang] = sums.get(lang, 0) + counts[these] @ vectors(keys[these] % CODES**GRAM).astype(np.float64)
        return [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            texts, langs = (batch.column(k).slice(at, 128).to_pylist() for k in (0, 1))
            own = [place.setdefault(x, len(place)) for x in langs]
            g, n = grams_of(texts)
            parts.append(np.unique(np.repeat(np.array(own, np.int64), n) * CODES**GRAM + g, return_counts=True))
            held += len(parts[-1][0])
            if held >= 2 * COUNTED:
                parts, held = fold(False)
    if parts:
        fold(True)
    if place:
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array([np.broadcast_to(sums.get(x, 0.0), DIMS).tolist() for x in place], pa.list_(pa.float64()))], names=["lang", "sums"])


def learned(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], DataFrame]:
    """Languages, and ``text`` and ``lang`` of every row that has both."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    names = [r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return sorted(names), rows


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all rows."""
    names, rows = learned(df, text, lang)
    if not names:
        return [], np.zeros((0, DIMS))
    # Tasks' sums are added up by Spark (whole numbers, so in any order): the driver gets one of each language.
    sums = rows.mapInArrow(trimmed(bundle), "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
    total = {n: np.zeros(DIMS) for n in names}
    for r in sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        total[r["lang"]][r["at"]] = r["x"]
    protos = np.array([total[n] for n in names])
    return names, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)


class Products:
    """Inner products of n-grams with each prototype, computed when an n-gram comes first; a full table starts anew."""

    def __init__(self, protos: np.ndarray):
        self.protos = protos.T.astype(np.float32)
        self.most = max(1, KEPT // max(1, len(protos)))
        self.place = np.full(CODES**GRAM, -1, np.int32)
        self.rows = np.zeros((0, len(protos)), np.float32)
        self.used = 0

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A row for each of ``grams``."""
        distinct, where = np.unique(grams, return_inverse=True)
        if len(distinct) > self.most:  # more at once than are kept: nothing is
            return np.concatenate([vectors(distinct[i : i + 4096]).astype(np.float32) @ self.protos for i in range(0, len(distinct), 4096)])[where]
        new = distinct[self.place[distinct] < 0]
        if self.used + len(new) > self.most:
            self.place[:] = -1
            self.used, new = 0, distinct
        if self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.used], np.zeros((min(self.most, 2 * (self.used + len(new))) - self.used, self.rows.shape[1]), np.float32)])
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.place[part] = np.arange(self.used, self.used + len(part))
            self.rows[self.used : self.used + len(part)] = vectors(part).astype(np.float32) @ self.protos
            self.used += len(part)
        return self.rows[self.place[grams]]


def products(names: list[str], protos: np.ndarray) -> Products:
    """The table of a model, known by all of it; a worker keeps the last one."""
    key = hashlib.sha256(repr((names, protos.shape)).encode() + np.ascontiguousarray(protos).tobytes()).digest()
    if key not in _products:
        _products.clear()
        _products[key] = Products(protos)
    return _products[key]


def classify(names: list[str], protos: np.ndarray, column: int, evidence: bool = False):
    """Append the prediction and its score to each row (``evidence``: the prediction, its evidence and the number of n-grams); ``column``: the text's."""

    def run(batches):
        known = products(names, protos)
        for batch in batches:
            preds, scores, levels, grams = [], [], [], []
            for at in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(column).slice(at, 64).to_pylist()]
                g, n = grams_of(texts)
                near = known.of(g) if names else None
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                for k, t in enumerate(texts):
                    if not n[k] or not names:
                        preds.append("und")
                        scores.append(0.0)
                        levels.append(0.0)
                        grams.append(0)
                        continue
                    cos = near[starts[k] : starts[k] + n[k]].sum(0, dtype=np.float64) / n[k]
                    best = int(np.argmax(cos))  # equal cosines: the first language by name
                    # Share of the best among the positive similarities.
                    pos = np.maximum(cos, 0)
                    preds.append(names[best])
                    levels.append(float(cos[best]))
                    grams.append(int(n[k]))
                    scores.append(float(pos[best] / pos.sum()) if pos.sum() > 0 else 0.0)
            pred = pa.array(preds, pa.string())
            more = {"_pred": pred, "_level": pa.array(levels, pa.float64()), "_grams": pa.array(grams, pa.int64())} if evidence else {"lang_pred": pred, "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    return run


def with_language(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` in [0, 1]; columns of these names are replaced."""
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(trimmed(classify(*model, df.columns.index(text))), schema)


def with_evidence(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``_pred``, ``_level`` and ``_grams``."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pred", T.StringType()), T.StructField("_level", T.DoubleType()), T.StructField("_grams", T.LongType())])
    return df.mapInArrow(trimmed(classify(*model, df.columns.index(text), evidence=True)), schema)


def floors(df: DataFrame, model: tuple[list[str], np.ndarray]) -> dict[str, float]:
    """The evidence that each language asks for, from all documents that are predicted as labelled."""
    names, rows = learned(df)
    if not names:
        return {}
    own = with_evidence(rows, model).where(F.col("_pred") == F.col("lang"))
    return {r["_pred"]: FLOOR * r["m"] for r in own.groupBy("_pred").agg(F.percentile_approx("_level", 0.5).alias("m")).collect()}  # a row for each language


def kept(df: DataFrame, model: tuple[list[str], np.ndarray], least: dict[str, float], text: str = "text") -> DataFrame:
    """The rows of ``df`` in a learned language: with letters, and with the evidence that ``least`` asks for."""
    names = df.columns
    df, back = aside(df, {"_pred", "_level", "_grams"})
    judged = with_evidence(df, model, text).where("_grams > 0")
    asked = F.coalesce(F.create_map(*[F.lit(x) for k in least for x in (k, least[k])])[F.col("_pred")], F.lit(0.0)) if least else F.lit(0.0)
    return judged.where(F.col("_level") + NOISE / F.sqrt("_grams") >= asked).select(*df.columns).withColumnsRenamed(back).select(*names)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return with_language(docs.select("doc_id", "text"), model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
