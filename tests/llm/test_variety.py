"""The variety labeller reads all words."""

from snapwarden.llm import quality


def value(words):
    return quality.statistics(" ".join(words))[1 + quality.LABELLERS.index("variety")]


def test_variety_of_long_texts_has_no_stride():
    lines = [w for k in range(400) for w in ["Question:", *[f"w{9 * k + j}" for j in range(9)]]]
    assert value(lines) > 0.85
    assert value([f"w{i}" for i in range(200) for _ in range(100)]) < 0.05
    assert 0.2 < value(["same"] * 3000 + [f"w{i}" for i in range(1000)]) < 0.3
    assert value(["a", "b", "a", "c"]) == 0.75
