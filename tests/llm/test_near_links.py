"""Links of a large group: one for each member, not one for each tree."""

from trade_insights.llm import near
from trade_insights.llm.graph import components


def test_a_member_has_one_link_whatever_its_heads(spark):
    heads, members = list(range(1, 21)), list(range(100, 400))
    links = [(m, h) for m in members for h in heads if h != m % 20 + 1] + [(900, 901)]
    df = spark.createDataFrame(links, "a long, b long")
    star = near._star(df)
    rows = star.collect()
    assert len(rows) < len(members) + 3 * len(heads) and len(rows) < len(links) / 10
    roots = lambda d, name: sorted(map(tuple, components(d, name).select("node", "root").collect()))
    assert roots(star, "test-star") == roots(df, "test-links")
