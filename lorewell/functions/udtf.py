"""Table functions for SQL: ``register(spark)`` makes them known in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lorewell.functions.tokens import DEFAULT
from lorewell.operators.markdown import MAX_TOKENS, chunk_text, heading_levels


@udtf(returnType="heading string, content string, chunk_index int, token_count int")
class ChunkMarkdown:
    """``SELECT * FROM files, LATERAL chunk_markdown(text, filename, 8000)``"""

    def eval(self, text: str, filename: str, max_tokens: int = MAX_TOKENS) -> Iterator[tuple]:
        for i, (heading, content) in enumerate(chunk_text(text or "", filename or "", max_tokens or MAX_TOKENS)):
            yield heading, content, i, len(DEFAULT.encode(content))


@udtf(returnType="line_no int, level int, title string")
class MarkdownHeadings:
    """``SELECT * FROM files, LATERAL markdown_headings(text)``"""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").split("\n")
        for i, (line, level) in enumerate(zip(lines, heading_levels(lines))):
            if level:
                yield i, level, line.lstrip("#").strip()


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
    spark.udtf.register("markdown_headings", MarkdownHeadings)
