import random

from placeloom.llm import htmltext as H


def node(label, *kids):
    return [label, 1, list(kids), {}, 0, 0, 0, 0]


def plain(xs, ys):
    """The whole table of scores and the way back through it."""
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + H.match(x, y, {}))
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if (w := H.match(xs[i - 1], ys[j - 1], {})) and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_aligned_as_by_the_whole_table(monkeypatch):
    monkeypatch.setattr(H, "SCORES", 3)  # scores that are not kept are worked out again
    rnd = random.Random(1)
    for _ in range(60):
        xs, ys = ([node(rnd.choice("ab"), *[node(rnd.choice("cde")) for _ in range(rnd.randrange(4))]) for _ in range(rnd.randrange(1, 9))] for _ in range(2))
        assert H.align(xs, ys, {}) == plain(xs, ys)


def test_many_children_are_aligned_as_few():
    """One aligned pair beside 201 x 201 others: the pairs of the first 40 don't depend on how many follow."""
    rnd = random.Random(2)
    xs, ys = ([node(rnd.choice("ab"), *[node(rnd.choice("cdef")) for _ in range(rnd.randrange(4))]) for _ in range(40)] for _ in range(2))
    few = H.align(xs, ys, {})
    more = [node(f"z{k}") for k in range(200)]
    assert [p for p in H.align(xs + more, ys + more, {}) if p[0] < 40] == few
    assert len(H.align(xs + more, ys + more, {})) == len(few) + 200
