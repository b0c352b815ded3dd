"""Long lists of siblings are aligned exactly, whatever their length."""

import random

import pytest

from panelforge.llm import html_extract
from panelforge.llm.html_extract import Shapes, aligned, fold, match, parse


def plain(a, b):
    """Simple tree matching with whole tables, and of equal matches the one of the earliest places."""
    if a.label != b.label:
        return 0, []
    x, y = fold(a), fold(b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, (_, held) in enumerate(x, 1):
        for j, (_, there) in enumerate(y, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain(held[0], there[0])[0])
    i, j, pairs = len(x), len(y), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[len(x)][len(y)], pairs[::-1]


def page(rng, n, depth=2):
    kinds = ["p", "h2", "section", "div", "ul", "table"]
    out = []
    for _ in range(n):
        k = rng.choice(kinds)
        out.append(f"<{k}>{page(rng, rng.randint(0, 3), depth - 1) if depth and k in ('section', 'div') else 'x'}</{k}>")
    return "".join(out)


@pytest.mark.parametrize("small,cells", [(4_096, 1 << 20), (0, 1 << 20), (0, 40), (16, 7)])
def test_any_way_through_the_table_gives_the_plain_match(monkeypatch, small, cells):
    monkeypatch.setattr(html_extract, "SMALL", small)
    monkeypatch.setattr(html_extract, "CELLS", cells)
    rng = random.Random(small + cells)
    for n in [0, 1, 2, 3, 5, 8, 13, 21] * 12:
        one = page(rng, n)
        two = page(rng, rng.randint(0, n + 2)) if rng.random() < 0.5 else one[: len(one) // 2] + page(rng, 2) + one[len(one) // 2 :]
        a, b = parse(f"<body>{one}</body>"), parse(f"<body>{two}</body>")
        assert match(a, b, {})[0] == plain(a, b)[0]
        a, b = a.children[0], b.children[0]
        assert match(a, b, {}) == plain(a, b)


def test_long_lists_are_not_matched_from_left_to_right():
    # the only footer stands first on one page and last on the other: taken by labels alone it would use up all the rest
    rows = "".join(f"<p>{i}</p><h2>{i}</h2>" for i in range(400))
    a, b = parse(f"<table></table>{rows}"), parse(f"{rows}<table></table>")
    size, pairs = match(a, b, {})
    assert size == 801 and pairs == [(i + 1, i) for i in range(800)]


def test_lists_of_many_slots_take_little_memory_and_time():
    shapes = Shapes()
    kinds = [shapes.of(node) for node in [parse(f"<{t}></{t}>").children[0] for t in ("p", "ul", "table", "section")]]
    rng = random.Random(1)
    x = tuple(rng.choice(kinds) for _ in range(30_000))
    y = (*x[:9_000], kinds[0], *x[9_003:25_000], kinds[1], kinds[2], *x[25_000:])
    size, pairs = aligned(x, y, shapes)
    assert size == len(pairs) >= 29_997 and all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs)
