"""Language identification in two steps: family first, then the languages within it.

Texts are counts of hashed byte 2- and 3-grams (ASCII lower-cased, square roots, to length
one). One linear machine for each family against the rest picks the family; inside a
family one machine for each pair of languages votes, the larger sum of margins deciding
ties. Every language that may be learnt from is learnt. Examples are a bounded sample,
``PER_LANGUAGE`` documents of each language in hash order; each family is trained in a Spark
group of its own against about ``REST`` examples of all other languages, the same number of
each. The model grows by one column for each family and pair. What is counted and scored are
whole texts.

Of an id with several texts in one language, the one with the smallest hash is the example.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every
text if nothing could be learnt; with a single language known, that one is predicted with
score 1; repeated rows are scored one by one; texts of any length are counted whole; of languages with equal votes and
margins the last by name is taken; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import held_out, text_bytes, written
from memlake.llm.grams import BUCKETS, gram_rows, linear_svm
from memlake.plans.ranking import top_n

PER_LANGUAGE = 250
#: Parts in which the ids of a language are cut to their first PER_LANGUAGE.
SALTS = 16
#: Examples of other languages that a family is told from; one of each language at least.
REST = 4000
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
    "turkic": ("az", "kk", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
}


@dataclass
class Model:
    families: list[list[str]]
    family_weights: np.ndarray  # a column for each family
    pair_weights: dict[tuple[str, str], np.ndarray]  # above 0: the first

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.family_weights[:-1] + self.family_weights[-1]
        chosen = margins.argmax(axis=1)
        rival = np.sort(margins, axis=1)[:, -2] if margins.shape[1] > 1 else np.full(len(x), -1.0)
        sure = _squash(margins.max(axis=1) - rival) if margins.shape[1] > 1 else np.ones(len(x))
        out: list[str] = [""] * len(x)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            votes = np.zeros((len(rows), len(languages)))
            total = np.zeros((len(rows), len(languages)))
            for a, b in combinations(range(len(languages)), 2):
                w = self.pair_weights[languages[a], languages[b]]
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                total[:, a] += m
                total[:, b] -= m
            best = np.lexsort((total.T, votes.T), axis=0)[-1] if len(rows) else np.zeros(0, int)
            for r, i in zip(rows.tolist(), best.tolist()):
                out[r] = languages[i]
            if len(languages) > 1 and len(rows):
                sure[rows] *= _squash(2 * total[np.arange(len(rows)), best] / (len(languages) - 1))
        return out, sure


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * margin))


def examples(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``lang``, ``rank`` and ``text`` that may be learnt from: held-out ids, null languages and texts without a letter are left out."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # a frequent language is cut in SALTS parts first, so that no task takes what all others hand on
    dealt = usable.select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("_salt")).distinct()
    some = top_n(dealt, per_language, ["lang", "_salt"], order, "_first").drop("_salt", "_first")
    ids = top_n(some, per_language, ["lang"], order)
    # per_language ids of each language
    held = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["lang", "doc_id"])
    return held.groupBy("lang", "doc_id", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "rank", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for i, j, x in gram_rows(data, bounds):
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), batch.column("rank").slice(i, j - i), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "rank", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    rows = written(examples(docs, per_language).mapInArrow(_features, "lang string, rank int, x binary"), "language-examples")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    family_of = {code: name for name, codes in families.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for v in languages:
        groups.setdefault(family_of.get(v, f"={v}"), []).append(v)
    groups = dict(sorted(groups.items()))
    each = max(1, REST // max(1, len(languages) - 1))
    # REST examples, or one of each language
    rest = rows.sparkSession.sparkContext.broadcast(rows.filter(F.col("rank") <= each).select("lang", "x").toArrow())

    def train(own: pa.Table) -> pa.Table:
        family = own.column("family")[0].as_py()
        mine = groups[family]
        others = rest.value.filter(pa.compute.invert(pa.compute.is_in(rest.value.column("lang"), pa.array(mine))))
        lang, x = _matrix(own)
        out = []
        if others.num_rows:
            held = pa.concat_tables([own.select(["lang", "x"]).cast(others.schema), others])
            named, all_x = _matrix(held)
            out.append((family, None, None, linear_svm(all_x, np.where(np.isin(named, mine), 1.0, -1.0))))
        for a, b in combinations(mine, 2):
            pair = (lang == a) | (lang == b)
            out.append((family, a, b, linear_svm(x[pair], np.where(lang[pair] == a, 1.0, -1.0))))
        return pa.table({
            **{k: pa.array([r[i] for r in out], pa.string()) for i, k in enumerate(("family", "a", "b"))},
            "weights": pa.array([r[3].astype(np.float32).tobytes() for r in out], pa.binary()),
        })

    named = F.coalesce(*[F.when(F.col("lang").isin(v), F.lit(f)) for f, v in groups.items() if f in families], F.concat(F.lit("="), F.col("lang")))
    found = rows.withColumn("family", named).groupBy("family").applyInArrow(train, "family string, a string, b string, weights binary").collect()
    weights = np.zeros((BUCKETS + 1, len(groups)), np.float32)
    pairs = {}
    for r in found:
        if r["a"] is None:
            weights[:, list(groups).index(r["family"])] = np.frombuffer(r["weights"], np.float32)
        else:
            pairs[r["a"], r["b"]] = np.frombuffer(r["weights"], np.float32)
    return Model(list(groups.values()), weights, pairs)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Languages and features in an order of their own, whatever order rows came in."""
    rows = rows.sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.stack([np.frombuffer(r, np.float16) for r in rows.column("x").to_pylist()]).astype(np.float32)
    return np.array(rows.column("lang").to_pylist()), x


def identify(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    body = F.col(text).cast("string")
    wanted = docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a column of the buckets for each family and pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            for i, j, x in gram_rows(data, bounds):
                names, sure = model.predict(x) if model else ([UNKNOWN] * (j - i), np.zeros(j - i))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i),
                    pa.array([n if ok else UNKNOWN for n, ok in zip(names, lettered[i:j])], pa.string()), pa.array(np.where(lettered[i:j], sure, 0.0).astype(float)),
                ], ["doc_id", "lang_pred", "score"])

    return wanted.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
