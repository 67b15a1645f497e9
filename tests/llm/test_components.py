"""Rounds of the components: as many as the links ask for."""

from granary.llm import components


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda links: rounds.append(1) or stars(links))
    found = lambda links: sorted(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found([(1, 2), (3, 1), (1, 3), (5, 4)]) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert not rounds
    assert found([(3, 1), (3, 2), (4, 3), (9, 8)]) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert len(rounds) == 1
    assert found([]) == []
