"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the distinct letter runs of a text (A-Z lower-cased) and their first four, five and six bytes, so stems and
compounds count. Weights are fitted on a bounded sample of labelled rows: about `per_class` rows of each label
(parameter, 4,096), chosen by a seeded hash of doc_id; scoring covers every text whole.

Counterfactual term: in each sampled text that names a group, every named term is swapped for each other term of its
swap class and for a blank, and the squared change of the score's logit is added to the loss. Terms of a class then
weigh alike, and the blank draws their weight towards none, so that naming a group neutrally does not raise the score
(a class' neutral word alone would not: where the corpus lacks it, it would take on the others' weight). Swap classes
are a parameter; SWAP_CLASSES has them for four languages. The model tells how many pairs it was fitted on (`swapped_pairs`).

The corpus stays on the executors: they sum each feature's counts over the sample and keep those that tell the labels
apart by SIGMAS standard deviations; the driver gets, for each sampled row, which of these it has, and for each swap
which of them the swapped word alone accounts for.

Defined results: null and empty texts get the score of a text without features; an unlabelled or null label row is not
learnt from; very long texts are scored whole; a table without labels of both kinds gives the constant score 0 (nothing is flagged); repeated rows are
scored alike; rows with a null doc_id are scored but not held out. Columns named score or predicted are replaced, others
pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, raw_text, read_table, slices
from .words import NOT_LETTER, Words

#: Terms that may be swapped for each other; the first of each class is neutral. Fixed values.
SWAP_CLASSES = {
    "en": (
        ("people", "women", "men", "girls", "boys"),
        ("people", "muslims", "christians", "jews", "hindus", "atheists"),
        ("person", "muslim", "christian", "jewish", "hindu", "atheist"),
        ("person", "black", "white", "asian", "latino", "indigenous"),
        ("person", "gay", "straight", "lesbian", "bisexual", "transgender"),
        ("people", "immigrants", "refugees", "foreigners", "natives"),
        ("person", "deaf", "blind", "disabled", "autistic"),
    ),
    "de": (
        ("menschen", "frauen", "männer", "mädchen", "jungen"),
        ("menschen", "muslime", "christen", "juden", "hindus", "atheisten"),
        ("menschen", "einwanderer", "flüchtlinge", "ausländer", "einheimische"),
        ("mensch", "schwule", "lesbe", "gehörlose", "blinde", "behinderte"),
    ),
    "fr": (
        ("personnes", "femmes", "hommes", "filles", "garçons"),
        ("personnes", "musulmans", "chrétiens", "juifs", "hindous", "athées"),
        ("personnes", "immigrés", "réfugiés", "étrangers", "autochtones"),
        ("personne", "homosexuel", "lesbienne", "sourd", "aveugle", "handicapé"),
    ),
    "es": (
        ("personas", "mujeres", "hombres", "niñas", "niños"),
        ("personas", "musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
        ("personas", "inmigrantes", "refugiados", "extranjeros", "nativos"),
        ("persona", "homosexual", "lesbiana", "sordo", "ciego", "discapacitado"),
    ),
}
Classes = tuple[tuple[str, ...], ...]
ALL_CLASSES: Classes = tuple(c for classes in SWAP_CLASSES.values() for c in classes)
#: How far from equal a feature's share in the two labels must be, in standard deviations; loss weight of swaps.
SIGMAS, FAIRNESS = 4, 5.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
_SALTS = np.array([0, *PREFIXES], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Letter runs of the texts, and a (runs, 1 + prefixes) array of 32-bit features; 0 stands for none."""
    words = Words(raw, offsets, fold_case=True, between=NOT_LETTER)
    size = words.end - words.start
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint32)
    out[:, 0] = (words.span_hash(words.start, words.end) + _SALTS[0]) >> np.uint64(32)
    for k, n in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(size > n)
        out[longer, k] = (words.span_hash(words.start[longer], words.start[longer] + n) ^ _SALTS[k]) >> np.uint64(32)
    return words, out


def _term_features(terms) -> dict[str, np.ndarray]:
    raw, offsets = raw_text(pa.array(list(terms), pa.string()))
    words, f = _features(raw, offsets)
    return {t: f[words.first[k] : words.first[k + 1]] for k, t in enumerate(terms)}


def _row_features(batches):
    """label, and the distinct features of each sampled text."""
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, f = _features(*raw_text(pa.array([text or ""], pa.large_string())))
            own = np.unique(f)
            own = own[own > 0].astype(np.int64)
            for k in range(0, len(own), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[k : k + (1 << 16)]), label, np.int32)), pa.array(own[k : k + (1 << 16)])], names=["label", "feature"])


def _positions(chosen: np.ndarray, terms: list[str]):
    """label, places of a text's features in `chosen`, and (term, places that only this word accounts for) of each term in it."""
    own = _term_features(terms)
    code = {int(own[t][0, 0]): k for k, t in enumerate(terms)}
    known = np.array(list(code), np.uint32)

    def places(f):
        at = np.searchsorted(chosen, f).clip(0, max(len(chosen) - 1, 0))
        return at[chosen[at] == f].astype(np.int32) if len(chosen) else np.zeros(0, np.int32)

    def run(batches):
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, f = _features(*raw_text(pa.array([text or ""], pa.large_string())))
                every, named, lost = np.unique(f), [], []
                for h in np.unique(f[:, 0][np.isin(f[:, 0], known)]).tolist():
                    named.append(code[h])
                    lost.append(places(np.setdiff1d(every, f[f[:, 0] != h])).tolist())
                row = [[label], [places(every).tobytes()], [named], [lost]]
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["label", "places", "named", "lost"])

    return run


def sample_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, toxic of about `per_class` rows of each label, by a seeded hash."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    u = (F.xxhash64(F.lit("toxicity"), "doc_id").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, per_class / max(n.get(1, 0), 1)).otherwise(per_class / max(n.get(0, 0), 1))
    return labels.where(u < share)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4096, fairness: float | None = None, classes: Classes = ALL_CLASSES) -> dict:
    """Weights from a bounded sample: sorted 32-bit features, their weights, a bias, and the number of swapped pairs."""
    fairness = FAIRNESS if fairness is None else fairness
    sample = sample_labels(labels, per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about 2 * per_class label rows
    rows = materialise(rows.select(F.col("toxic").cast("int").alias("label"), "text"), "sample")
    none = {"features": np.zeros(0, np.uint32), "weights": np.zeros(0), "bias": -np.inf, "swapped_pairs": 0}
    n1, n0 = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n1 or not n0:
        return none
    counts = rows.mapInArrow(_row_features, "label int, feature long").groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("df1"), F.count_if(F.col("label") == 0).alias("df0"))
    share = (F.col("df1") + F.col("df0")) / (n1 + n0)
    z = (F.col("df1") / n1 - F.col("df0") / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    told = counts.where((F.col("df1") + F.col("df0") >= 2) & (F.abs(z) > SIGMAS)).select("feature").toArrow()
    terms = sorted({t for c in classes for t in c})
    own = _term_features(terms)
    term_features = np.unique(np.concatenate([f.ravel() for f in own.values()])) if terms else np.zeros(0, np.uint32)
    chosen = np.union1d(np.asarray(told.column(0)).astype(np.uint32), term_features[term_features > 0]).astype(np.uint32)
    table = rows.mapInArrow(_positions(chosen, terms), "label int, places binary, named array<int>, lost array<array<int>>").toArrow()
    discard(rows)
    y = np.asarray(table.column("label")).astype(float)
    parts = [np.frombuffer(x, np.int32) for x in table.column("places").to_pylist()]
    row, col = np.repeat(np.arange(len(y)), [len(x) for x in parts]), np.concatenate(parts)

    # a swap takes away what only the named word accounts for, and adds what the other one has and the text has not
    gains = {t: np.searchsorted(chosen, np.unique(f[f > 0])) for t, f in own.items()}
    others = {t: sorted({x for c in classes if t in c for x in c} - {t}) for t in terms}
    d_rows, d_cols, d_vals = [], [], []
    pairs = 0
    for have, named, lost in zip(parts, table.column("named").to_pylist(), table.column("lost").to_pylist(), strict=True):
        for k, gone in zip(named, lost, strict=True):
            rest = np.setdiff1d(have, gone)
            for t in (*others[terms[k]], None):
                more = np.setdiff1d(gains[t], rest) if t else np.zeros(0, int)
                d_rows.append(np.full(len(more) + len(gone), pairs))
                d_cols.append(np.r_[more, np.array(gone, int)].astype(int))
                d_vals.append(np.r_[np.ones(len(more)), -np.ones(len(gone))])
                pairs += 1
    d_row, d_col, d_val = (np.concatenate(x) if pairs else np.zeros(0, int) for x in (d_rows, d_cols, d_vals))
    n, m = len(y), len(chosen)
    rate = max(labels.where("toxic = 1").count(), 1) / max(labels.where("toxic in (0, 1)").count(), 1)
    weight = np.where(y == 1, rate / n1, (1 - rate) / n0) * n
    w, b = np.zeros(m), float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    one, two, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, 801):
        score = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=n), -30, 30)))
        miss = weight * (score - y) / n
        g = np.bincount(col, weights=miss[row], minlength=m) + 5e-6 * w
        if len(d_row):
            change = np.bincount(d_row, weights=d_val * w[d_col], minlength=pairs) / pairs
            g += 2 * fairness * np.bincount(d_col, weights=d_val * change[d_row], minlength=m)
        gb = miss.sum()
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        pace = 0.2 * (1 - step / 840)
        w -= pace * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        b -= pace * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    return {"features": chosen.astype(np.uint32), "weights": w, "bias": float(b), "swapped_pairs": pairs}


def _score(raw: np.ndarray, offsets: np.ndarray, model: dict, table: np.ndarray) -> np.ndarray:
    words, f = _features(raw, offsets)
    n = len(offsets) - 1
    logit = np.full(n, model["bias"])
    if len(f) and len(model["features"]):
        at, k = np.nonzero(table[f & np.uint32((1 << 22) - 1)])
        hit = f[at, k]
        place = np.searchsorted(model["features"], hit).clip(0, len(model["features"]) - 1)
        ok = model["features"][place] == hit
        doc = np.searchsorted(words.first, at[ok], side="right") - 1
        pair = np.unique(doc.astype(np.int64) << 32 | place[ok])
        logit += np.bincount(pair >> 32, weights=model["weights"][pair & 0xFFFFFFFF], minlength=n)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-logit))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.7). The model is of bounded size and goes with the tasks."""

    @F.arrow_udf("double")
    def toxicity(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << 22, bool)
        table[model["features"] & np.uint32((1 << 22) - 1)] = True
        for part in parts:
            raw, offsets = raw_text(part)
            out = [_score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model, table) for i, j in slices(offsets)]
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    out = docs.drop("score", "predicted").withColumn("score", toxicity("text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
