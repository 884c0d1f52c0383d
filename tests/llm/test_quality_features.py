"""The twelve features against a plain reading, the tables against adding them one by one."""

import math
import random

import numpy as np
import pytest

from compliance_scan.llm import quality_gam as q


def plain(text):
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = len(words)
    solid = max(1, sum(not c.isspace() for c in text))
    digits = sum(c.isdigit() for c in text if not c.isspace())
    upper = sum(c.isupper() and not c.isdigit() for c in text)
    lower = sum(c.isalpha() and not c.isupper() and not c.isdigit() for c in text)
    marks = sum(not (c.isspace() or c.isdigit() or c.isupper() or c.isalpha()) for c in text)
    pairs = list(zip(words, words[1:]))
    return [math.log1p(n), solid / n if n else 0, upper / max(1, upper + lower), digits / solid, marks / solid,
            len(set(words)) / n if n else 0, sum(a == b for a, b in pairs) / n if n else 0,
            max(map(words.count, words)) / n if n else 0, len(set(pairs)) / len(pairs) if pairs else 0,
            1 - len(set(lines)) / len(lines) if lines else 0, math.log1p(len(text) / max(1, len(lines))),
            math.log1p(max(map(len, words))) if n else 0]


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One two two THREE 3 4!\n\nsame line\nsame line", "ПРИВЕТ мир ΑΒΓ αβγ ١٢٣ 45", "東京、日本語。　全角 ＡＢ",
    "ǅ Ⅷ ª º ñ Ñ é  x​", "a" * 5000 + " b" * 3000, "👩‍👩‍👧 ☃ \x00\x1f"])
def test_features_of_any_script(text):
    assert q.features(text) == pytest.approx(plain(text))


def test_every_code_point_has_its_own_class():
    table = q._classes()
    for c in "AÀΑА": assert table[ord(c)] == q._UPPER
    for c in "aàαа東": assert table[ord(c)] == q._LOWER
    for c in "5٣९": assert table[ord(c)] == q._DIGIT
    for c in " 　 ": assert table[ord(c)] == q._SPACE
    for c in "!、。☃": assert table[ord(c)] == q._MARK


def test_score_is_the_sum_of_the_looked_up_values():
    rng = random.Random(3)
    x = np.array([[rng.random() * (j + 1) for j in range(len(q.FEATURES))] for _ in range(400)])
    y = np.array([float(r[0] + r[1] * r[2] > 1) for r in x])
    model = q.fit(x, y)
    for row in x[:60]:
        total = model.intercept
        for j, (edge, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(v <= row[j] for v in edge)]
        for a, b, table in model.pairs:
            total += table[sum(v <= row[a] for v in model.coarse[a]), sum(v <= row[b] for v in model.coarse[b])]
        assert model.margin(row[None, :])[0] == pytest.approx(total)
    assert np.mean((model.score(x) >= 0.5) == (y == 1)) > 0.95
