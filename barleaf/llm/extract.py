"""Main text of web pages by the marginals of a tree model over their elements.

A text block is kept if the marginal probability of its element being content
is over one half; blocks are joined in page order by line feeds, with character
references decoded and white space inside a block as one space.

Defined results: a null or empty page, and one without content, gives an empty
text; null urls, null keys and repeated rows pass through, one row per input
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barleaf.llm.common import pick
from barleaf.llm.dom import Page
from barleaf.llm.pagemodel import TreeModel, trained

SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(html: str, model: TreeModel) -> str:
    page = Page(html)
    odds = model.content(page)
    return "\n".join(text for node, text in page.blocks if odds[node] > 0)


def extract(pages: DataFrame) -> DataFrame:
    model = trained()  # a few hundred weights; it goes with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", model) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, SCHEMA)
