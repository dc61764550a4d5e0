"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks; each is described by its own and its neighbours' word count and
link density and by the elements around it. A tree fitted on the small table of labelled
pages below says which blocks belong to the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import whole_text
from quorate.llm.decision_tree import Tree
from quorate.llm.html_blocks import Block, text_blocks

# Labelled pages, one line each: the labels of the blocks (1: main text), then the page.
# A number stands for so many words, with an ``a`` before it for so many linked words.
LABELLED = """
00110 <nav><ul><li>a1</li><li>a1</li></ul></nav><article><h1>8</h1><p>60</p></article><footer>9</footer>
00011111000 <nav><li>a1</li><li>a2</li></nav><div class=ad>7</div><article><h1>6</h1><p>1</p><p>3</p><p>80</p><p>2</p></article><footer>12</footer><aside>30</aside><div id=comments>25</div>
01111000 <header>4</header><main><h1>5</h1><p>40</p><h2>3</h2><p>12 a4</p><div class=newsletter>14</div><form>6</form></main><footer>a5</footer>
0111100 <div class=cookie>35</div><article><header><h1>9</h1></header><p>25</p><blockquote>18</blockquote><ul><li>11</li></ul><section class=comments><p>50</p><p>40</p></section></article>
1110000 <article><p>1</p><p>1</p><p>1</p></article><aside><p>1</p><p>90</p></aside><div class=related><a>4</a></div><div class=share>a2</div>
1111000 <main><p>200</p><table><tr><td>2</td><td>1</td><td>3</td></tr></table></main><nav><li>a3</li><li>a3</li><li>a3</li></nav>
0000 <nav><li>a2</li><li>a2</li></nav><form><p>20</p></form><footer>30</footer>
11100 <article><p>30 a9</p><p>a6</p><p>45</p></article><div class=sidebar><p>60</p><p>a8</p></div>
1100011 <article><h1>7</h1><p>35</p><p>a3</p><p>a4</p><p>a3</p><p>28</p><p>5</p></article>
000111100 <div><p>a1</p><p>a2</p><p>a1</p></div><div><h1>7</h1><p>50</p><p>70</p><p>22</p></div><div><p>a3</p><p>a2</p></div>
00111000 <p>a2</p><p>3</p><h2>6</h2><p>33</p><p>26</p><p>2</p><p>a4</p><p>a3</p>
01110 <p>4</p><p>45</p><p>5</p><p>38</p><p>3 a3</p>
0011110 <td>a2</td><td>a3</td><td>90</td><td>60 a8</td><td>12</td><td>47</td><td>a6</td>
1 <p>30</p>
0 <p>a5</p>
0000 <p>2</p><p>3</p><p>1</p><p>4</p>
111 <div class=post><p>3</p><p>20</p><p>2</p></div>
01100 <div class=banner>15</div><div class=content><p>16</p><p>4</p></div><div class=footer>18</div><div class=legal>44</div>
0110 <div>14</div><article><h1>4</h1><p>50</p></article><div>33</div>
0001100 <p>a9</p><div>60</div><div>2</div><main><p>3</p><p>70</p></main><div>a8</div><p>8</p>
00110 <p>a9</p><p>a12</p><p>60</p><p>9 a2</p><p>a15</p>
0110 <p>7 a20</p><p>30 a4</p><p>25</p><p>2 a9</p>
0110 <div role=navigation>a9</div><div role=main><p>9</p><p>55</p></div><div role=contentinfo>21</div>
"""


def features(blocks: list[Block]) -> list[list[float]]:
    """Per block: words and link density of itself and its neighbours, and its surroundings."""
    edge = Block("", 0, 0, False, False, False)
    held = float(any(block.in_main for block in blocks))
    around = [edge, *blocks, edge]
    words = [float(block.words) for block in around]
    density = [block.link_density if block.words else 0.0 for block in around]
    return [
        [float(block.beside), float(block.in_main), held, words[k], density[k], words[k - 1],
         density[k - 1], words[k + 1], density[k + 1], float(block.heading)]
        for k, block in enumerate(blocks, 1)
    ]


def fitted() -> Tree:
    """The tree of the labelled pages."""
    def written(match: re.Match[str]) -> str:
        text = "word " * int(match[2])
        return f" <a href=x>{text}</a> " if match[1] else text

    rows: list[list[float]] = []
    labels: list[bool] = []
    for line in LABELLED.strip().splitlines():
        marks, page = line.split(" ", 1)
        found = features(text_blocks(re.sub(r"(?<![\w<])(a?)(\d+)", written, page)))
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks, {len(marks)} labels: {line}")
        rows += found
        labels += [mark == "1" for mark in marks]
    return Tree.fit(np.array(rows), np.array(labels))


def main_text(html: str, tree: Tree) -> str:
    """The main text of one page: its blocks, joined by one space."""
    blocks = text_blocks(html)
    return " ".join(
        block.text for block, row in zip(blocks, features(blocks), strict=True) if tree(row)
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """The main text of every page, from its whole html.

    Input needs ``page_id``, ``url`` and ``html``; other columns are ignored, so their names
    cannot clash. Null or empty html, and pages without main text, give an empty text;
    repeated rows and null ids each give a row; an empty table gives an empty result. Very
    long pages are read whole, in time linear in their length. Unclosed or stray tags are
    taken as a browser would.

    Returns page_id, url, text, n_chars (code points).
    """
    tree = fitted()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, tree) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    kinds = dict(pages.dtypes)
    return (
        pages.select("page_id", "url", whole_text("html").alias("html"))
        .mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
        .withColumn("n_chars", F.length("text").cast("bigint"))
    )
