"""Helpers shared by the corpus operators: stored tables and word arrays."""

import string

from pyspark.sql import functions as F

from barwise.sources.files import shared_folder

#: Runs of bytes that are not part of a word, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space as the contracts count it.
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df):
    """Write ``df`` to a fresh shared folder and read it back: lineage ends there and its size is known to the planner."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """Lower-case A-Z alone. The built-in ``lower`` does just that unless other capitals occur."""
    other_capitals = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"
    return F.when(text.rlike(other_capitals), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(
        F.lower(text)
    )


def word_array(text):
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def row_key(*columns):
    """A 64-bit digest that, beside the identifier, tells rows of one identifier apart."""
    return F.xxhash64(*columns)


def packed(docs, *columns):
    """Every row as one struct ``row``, beside the named columns as ``id``, ``text`` and so on in the order given: names in the
    row can't clash with those of an operator."""
    names = ("id", "text", "source")
    return docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[F.col(quoted(c)).alias(n) for c, n in zip(columns, names)]
    )


def quoted(name):
    """A column name as an expression reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
