"""Language of documents from a linear-chain conditional random field over their words.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` documents of each language, those with the
smallest hashes of the identifier over all eligible rows (found by counting hash buckets, so no language is sorted), ``SNIPPETS`` runs of ``SNIPPET`` words of each. Prediction reads whole texts:
words are labelled with marginals by forward-backward, in sequences that overlap, and a document's language is the one with
the largest mean marginal, which is its score. Equal means go to the smaller label.

Cases: null texts, and texts without letters, are ``und`` with score 0, as is everything if no row is labelled; rows
without an identifier are neither trained on nor held out; repeated rows get the same prediction each; an empty table
gives an empty result; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from barwise.llm import crf
from barwise.llm.common import packed, stored

SAMPLE, SNIPPETS, SNIPPET = 500, 6, 20
UNKNOWN = "und"
_WORDS = 400_000  # labelled at a time


def held_out(id_col):
    """Whether crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _snippets(batches):
    for batch in batches:
        langs, texts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = crf.text_words(text)
            for at in np.linspace(0, max(len(words) - SNIPPET, 0), SNIPPETS).astype(int).tolist():
                if words:
                    langs.append(lang)
                    texts.append(" ".join(words[at : at + SNIPPET]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "words"])


def _smallest(rows, sample):
    """The ``sample`` rows (id, lang) of each language with the smallest hashes: whole hash buckets as long as they fit, then
    the same inside the bucket that does not, and only what is left there is put in order."""
    rows = stored(rows.withColumn("h", F.xxhash64("id")))
    at = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge, whole, shift = rows.select("lang").distinct().select("lang", F.lit(0).cast("long").alias("taken")), None, 64
    for _ in range(2):
        shift -= 12
        bucket = F.shiftright("h", shift)
        counts = rows.join(edge, "lang").groupBy("lang", "taken", bucket.alias("bucket")).count()
        counts = counts.withColumn("before", F.col("taken") + F.coalesce(F.sum("count").over(at), F.lit(0)))
        last = counts.filter((F.col("before") < sample) & (F.col("before") + F.col("count") >= sample))
        last = stored(last.select("lang", F.col("bucket").alias("edge"), F.col("before").alias("taken")))
        inside = rows.join(last.select("lang", "edge"), "lang", "left")
        part = inside.filter(F.col("edge").isNull() | (F.shiftright("h", shift) < F.col("edge"))).select("id", "lang")
        whole = part if whole is None else whole.unionByName(part)
        rows = stored(inside.filter(F.shiftright("h", shift) == F.col("edge")).select("id", "lang", "h"))
        edge = last.select("lang", "taken")
    by = Window.partitionBy("lang").orderBy("h", "id")
    rest = rows.withColumn("n", F.row_number().over(by)).join(edge, "lang").filter(F.col("n") + F.col("taken") <= sample)
    return whole.unionByName(rest.select("id", "lang"))


def fit(docs, id_col="doc_id", text_col="text", lang_col="lang", sample=SAMPLE):
    """Learn from the rows that are labelled and not held out."""
    able = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = able.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = stored(_smallest(rows.filter(F.col("text").isNotNull()).select("id", "lang"), sample))
    texts = rows.filter(F.col("text").isNotNull()).join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi")
    found = texts.select("lang", "text").mapInArrow(_snippets, "lang string, words string").toArrow()
    return crf.fit(sorted(zip(found.column(0).to_pylist(), (w.split(" ") for w in found.column(1).to_pylist()))))


def predict(texts, model):
    """(labels, scores) of a list of texts."""
    return _judge(texts, model)[:2]


def _judge(texts, model, known=False):
    """(labels, scores, known) of a list of texts; known: whether the model accepts them, if asked for."""
    n = len(model.langs)
    sums, totals = np.zeros((len(texts), n)), np.zeros(len(texts))
    unseen, distinct = np.zeros(len(texts)), np.zeros(len(texts))
    queue, owners, waiting = [], [], 0

    def flush():
        post = model.marginals([s for s, _, _ in queue], [(lead, size) for _, lead, size in queue])
        of = np.repeat(owners, [size for _, _, size in queue])
        for k in range(n):
            sums[:, k] += np.bincount(of, post[:, k], len(texts))

    for i, text in enumerate(texts):
        words = crf.text_words(text) if text and n else []
        totals[i] = len(words)
        for at in range(0, len(words), _WORDS):
            part = words[at : at + _WORDS]
            if queue and waiting + len(part) > _WORDS:
                flush()
                queue, owners, waiting = [], [], 0
            rows = model.rows(part) if not queue else model.rows(part, most=1 << 60)
            if known:
                share, words_seen = model.unseen_share(rows)
                unseen[i] += share
                distinct[i] += words_seen
            queue += crf.sequences(rows)
            owners += [i] * (len(queue) - len(owners))
            waiting += len(part)
    if queue:
        flush()
    labels = [model.langs[int(k)] if t else UNKNOWN for k, t in zip(sums.argmax(1) if n else totals, totals)]
    best = sums.max(1) if n else totals
    scores = np.minimum(best / np.maximum(totals, 1), 1.0)
    accepted = [bool(t) and model.accepts(*x) for t, *x in zip(totals, scores, totals, unseen, distinct)] if known else None
    return labels, scores, accepted


def _predictions(shared):
    def run(batches):
        for batch in batches:
            labels, scores = predict(batch.column("text").to_pylist(), shared.value)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def languages(docs, model, id_col="doc_id", text_col="text"):
    """One row per document: id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictions(shared), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def word_languages(docs, model, id_col="doc_id", text_col="text"):
    """One row per document: id, words, and the language of each word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            all_words, all_langs = [], []
            for text in batch.column("text").to_pylist():
                words = crf.text_words(text or "") if model.langs else []
                rows = model.rows(words)
                found = crf.sequences(rows)
                best = model.marginals([s for s, _, _ in found], [(lead, size) for _, lead, size in found]).argmax(1) if found else []
                all_words.append(words)
                all_langs.append([model.langs[int(k)] for k in best])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(all_words, kind), pa.array(all_langs, kind)], ["id", "words", "langs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, words array<string>, langs array<string>")


def known_language(docs, model, text_col="text", least=0.0):
    """The documents with a language that the model accepts (``crf.Model.accepts``) and a score of ``least`` or more, with
    their own columns. Texts without letters go, and they alone if the model has no languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("row").field(text_col).to_pylist()
            if not shared.value.langs:
                yield batch.filter(pa.array([crf.has_letter(t) for t in texts], pa.bool_()))
                continue
            _, scores, accepted = _judge(texts, shared.value, known=True)
            yield batch.filter(pa.array([a and bool(s >= least) for a, s in zip(accepted, scores)], pa.bool_()))

    rows = packed(docs)
    return rows.mapInArrow(run, rows.schema).select("row.*")
