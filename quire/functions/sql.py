"""Table functions for SQL: SELECT * FROM fragments, LATERAL html_top_nodes(fragment)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.sources.html_nodes import top_nodes


class HtmlTopNodes:
    def eval(self, fragment: str):
        for k, (kind, tag, html, strings) in enumerate(top_nodes(fragment)):
            yield k, kind, tag, html, " ".join(s.strip() for s in strings if s.strip())


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_top_nodes", udtf(HtmlTopNodes, returnType="node_idx int, node_type string, tag string, html string, title string"))
