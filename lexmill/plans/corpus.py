"""Corpus build: spans in, validated articles out."""

from pyspark.sql import DataFrame

from lexmill import constants as K
from lexmill.operators import layout as L
from lexmill.session import stage


def articles_from_spans(spans: DataFrame, ranges: list[dict] | None = None, split_numbers: list[int] | None = None, **options) -> DataFrame:
    """All layout steps in order. Lines, headers and the articles before the split feed several joins, so they are staged."""
    lines = stage(L.column_lines(spans), "lines")
    headers = stage(L.select_headers(stage(L.header_candidates(lines), "candidates")), "headers")
    articles = L.build_articles(lines, headers, **options)
    articles = L.overlay_status(articles, lines, K.OVERLAY_RANGES if ranges is None else ranges)
    return L.split_merged(stage(articles, "unsplit-articles"), [1021] if split_numbers is None else split_numbers)
