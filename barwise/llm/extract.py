"""HTML extraction over a table of pages; see ``pages`` for the method.

Cases: a null or empty page, or one without text, gives the empty string; character references are decoded, also those
without a semicolon that HTML knows; broken markup never fails; repeated rows get the same result each; an empty table
gives an empty result; other columns are ignored.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from barwise.llm.pages import main_text


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        kept = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"]
        )


def extract(pages, id_col="page_id", url_col="url", html_col="html"):
    """One row per page: id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "url")]
    return rows.mapInArrow(_extract, ", ".join([*types, "text string", "n_chars long"]))
