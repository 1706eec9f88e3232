"""2-opt works out arcs only where chords shorten the tour, and its order is the one of the plain scan."""
import numpy as np

from pingframe.operators import clusters as C


def plain(lat, lon, rounds=8):
    p = C._ecef_np(lat, lon)
    span = lambda u, v: float(C._arc(np.sqrt(((u - v) ** 2).sum())))
    order, rest = [0], list(range(1, len(p)))
    while rest:
        order.append(min(rest, key=lambda k: (((p[k] - p[order[-1]]) ** 2).sum(), k)))
        rest.remove(order[-1])
    for _ in range(rounds):
        better = False
        for i in range(1, len(p) - 2):
            for j in range(i + 1, len(p) - 1):
                a, b, c, d = (p[order[k]] for k in (i - 1, i, j, j + 1))
                if span(a, c) + span(b, d) < span(a, b) + span(c, d) - 1e-9:
                    order[i:j + 1] = order[i:j + 1][::-1]
                    better = True
        if not better:
            break
    return order


def test_the_order_is_that_of_the_plain_scan():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 30, 45):
        for lat, lon in ((13 + r.random(n) * 0.01, 80 + r.random(n) * 0.01), (13 + r.integers(0, 4, n) * 5e-5, 80 + r.integers(0, 5, n) * 5e-5)):
            assert C.tour(lat, lon).tolist() == plain(lat, lon)


def test_arcs_are_worked_out_for_few_pairs(monkeypatch):
    r, seen, arc = np.random.default_rng(2), [], C._arc
    monkeypatch.setattr(C, "_arc", lambda c: seen.append(np.size(c)) or arc(c))
    C.tour(13 + r.random(600) * 0.01, 80 + r.random(600) * 0.01)
    assert sum(seen) < 600 * 600 / 2        # one scan of all pairs has twice as many, a tour several scans
