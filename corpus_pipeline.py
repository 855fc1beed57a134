"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

All stages but the last return the rows that stay with all their columns, whatever names and types these have. Texts are
read whole at any length. Repeated rows: the near-duplicate stage keeps one of them, the others treat each alike. An empty
table gives an empty table, and an empty result at the end.
"""

from barwise.llm import binary, decontaminate, langid, mixing, neardup
from barwise.llm.common import stored
from barwise.llm.queries import END_ID, LIMIT, WEIGHTS, table, vocabulary_file


def known_language(spark, docs, sf_dir):
    """Documents without letters (null and empty texts too), or of none of the languages learned, go. If no row has a usable
    label, no language is learned and all texts with letters stay. Equal means of two languages go to the smaller label."""
    return langid.known_language(docs, langid.fit(docs))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each class of near duplicates stays: the one with the smallest identifier that is not null, of rows
    with the same identifier and text any one. Null texts and texts without words are in no class with others and stay."""
    return neardup.keep_one(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Documents in which a benchmark window occurs go. Null and empty texts have no words and stay; of rows that share an
    identifier only those with the text that was hit go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them: repeats are rows, documents not taken go. A null source is a source of its
    own and comes last; documents without words have size 0 and follow their hash; equal hashes go together."""
    return mixing.take(docs, WEIGHTS, LIMIT)


def write_ids(spark, docs, sf_dir):
    """Token ids of all documents in wavelet matrix files; what the files say of each document. A null text is empty and has
    the end id alone; a document taken twice is written twice."""
    written = binary.encode(docs, vocabulary_file("byte_bpe_50k.json"), END_ID)
    return written.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("binary_output", write_ids),
]

#: Language models, sketches and tokenizers have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
