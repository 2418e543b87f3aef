"""Queries do the whole of their job: fixtures in which a cut of the input or of the result shows."""

from __future__ import annotations

import math
import random
from datetime import datetime
from hashlib import md5
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import queries as registry
from corpusloom.operators import sampling
from tests.data import prose


def run(spark, name: str, path, **tables) -> list:
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
    return registry.queries()[name](spark, str(path)).collect()


def test_lookup_joins_the_whole_table(spark, tmp_path) -> None:
    """Only an absent id, a null and a blank text are missing, whatever the id."""
    texts = [(i, f"text {i}") for i in range(12)] + [(20, None), (21, "  ")]
    ids = [*range(12), 20, 21, 30]
    got = run(spark, "text_lookup_left_join", tmp_path, documents=(texts, "doc_id long, text string"), labels=([(i, 3) for i in ids], "doc_id long, quality long"))
    assert {r["doc_id"]: (r["missing"], r["chars"]) for r in got} == {i: (False, len(f"text {i}")) for i in range(12)} | {20: (True, 0), 21: (True, 2), 30: (True, 0)}


def test_export_up_to_its_own_bound(spark, tmp_path) -> None:
    for n in (1200, 5100):
        customers = [(i, f"={i}" if i % 7 == 0 else f"n{i}", float(i - 600)) for i in range(n, 0, -1)]
        got = run(spark, "csv_export", tmp_path / str(n), customer=(customers, "c_custkey long, c_name string, c_acctbal double"))
        assert {r["c_custkey"]: r["c_name"] for r in got} == {i: f"'={i}" if i % 7 == 0 else f"n{i}" for i in range(1, min(n, 5000) + 1)}
        assert len(got) == min(n, 5000) and all(r["has_balance"] for r in got)


def test_bootstrap_of_2000_replicates(spark, tmp_path) -> None:
    """Both regions resampled by the same hashes in plain Python."""
    customers = [(c, c % 3, "SEG") for c in range(1, 31)]
    orders = [(o, o * 7 % 30 + 1, datetime(1995, 1 + o % 12, 1), f"{o * o % 5 + 1}-X") for o in range(150)]
    got = run(
        spark, "cluster_bootstrap", tmp_path, region=([(0, "A"), (1, "B")], "r_regionkey int, r_name string"), nation=([(0, 0), (1, 1), (2, 1)], "n_nationkey int, n_regionkey int"),
        customer=(customers, "c_custkey long, c_nationkey int, c_mktsegment string"), orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
    )
    reach = [int(2**31 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
    turned = lambda x, m: (x * m % 2**31) ^ (x * m % 2**31 >> 15)

    def weight(name: str, entity: int, rep: int) -> int:
        x = (int(md5(f"v1:{name}:{entity}".encode()).hexdigest()[:8], 16) % 2**31 + rep * 1640531527) % 2**31
        return sum(turned(turned(x, 1597334677), 1812433253) >= r for r in reach)

    want, weights = {}, []
    for name, nations in (("A", {0}), ("B", {1, 2})):
        values = {c: mean(int(p[0]) for _, k, _, p in orders if k == c) for c, n, _ in customers if n in nations and any(k == c for _, k, _, _ in orders)}
        stats = []
        for rep in range(1, 2001):
            w = {c: weight(name, c, rep) for c in values}
            weights += w.values()
            if any(w.values()):
                stats.append(sum(w[c] * v for c, v in values.items()) / sum(w.values()))
        want[name] = [float(np.percentile(stats, q)) for q in (5, 50, 95)]
    assert {r["r_name"]: [r["low"], r["mid"], r["high"]] for r in got} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert abs(np.mean(weights) - 1) < 0.02 and abs(np.var(weights) - 1) < 0.05  # as a Poisson distribution of mean 1 has them


def test_lowest_places_without_a_sort_of_the_label(spark) -> None:
    """A third of all rows share one hash, at which the limit may fall; against a sort in Python."""
    r = random.Random(8)
    rows = [(i * 10**6, "x" if i % 3 else "y", md5(str(r.randrange(40)).encode()).hexdigest() if r.random() < 0.6 else md5(b"hot").hexdigest()) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, label string, text_hash string").repartition(7)
    for limit in (0, 1, 57, 150, 199, 200, 10_000):
        got = {x["doc_id"] for x in sampling.head_by_hash(df, ["label"], F.lit(limit)).collect()}
        assert got == {x[0] for g in "xy" for x in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))[:limit]}


def shingles(text: str | None) -> set[tuple]:
    w = [x for x in "".join(c if c not in " \t\n\x0b\f\r" else " " for c in (text or "").lower()).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_of_whole_texts(spark, tmp_path) -> None:
    """Copies that differ at their start, short texts, a common opening that links nothing, chains; against all pairs in Python."""
    base = prose(1, 120)
    rows = [(0, base), (1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base.upper()), (6, base + " tail"), (7, prose(2, 20000)), (None, base), (8, "x" * 5000)]
    rows += [(100 + i, f"licence line that all of these documents share at the start {prose(200 + i, 40)}") for i in range(30)]
    rows += [(200, "early words here differ " + prose(300, 90)), (201, "other " + prose(300, 90)), (202, "hi all"), (203, "Hi  all"), (204, "hi you")]
    r, chain = random.Random(5), prose(301, 90).split(" ")
    for k in range(40):
        w = list(chain)
        for _ in range(k // 6):
            w[r.randrange(len(w))] = f"n{k}"
        rows.append((300 + k, " ".join(w)))
    links = run(spark, "near_dups_jaccard", tmp_path, documents=(rows, "doc_id long, text string"))
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    alike = {}
    group = {d: d for d, _ in sets}
    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                alike[min(d, e), max(d, e)] = round(len(x & y) / len(x | y), 6)
                low, high = sorted((group[d], group[e]))
                group = {k: low if g == high else g for k, g in group.items()}
    first = {d: min(e for e, y in sets if y == x) for d, x in sets}
    assert {(r["a"], r["b"]): r["jaccard"] for r in links} == {p: j for p, j in alike.items() if p[0] == first[p[1]] or {first[p[0]], first[p[1]]} == set(p)}
    groups = {r["id"]: r["component"] for r in registry.queries()["connected_groups"](spark, str(tmp_path)).collect()}
    linked = {d for p in alike for d in p}
    assert groups == {d: g for d, g in group.items() if d in linked} and groups[201] == 200 and groups[203] == 202 and 100 not in groups


def test_suppression_by_every_gate(spark, tmp_path) -> None:
    """A month that is released, and months that one change after another suppresses; each has its own reasons."""
    customers = [(c, c % 2, f"S{c // 2 % 5}") for c in range(200)]  # ten cells of 20 customers, equal weights
    orders = []

    def month(k: int, n: int, who) -> None:
        orders.extend((len(orders), who(i), datetime(1995, k, 1 + i % 28), "4-X") for i in range(n))

    month(1, 500, lambda i: i % 200)
    month(2, 499, lambda i: i % 200)
    month(3, 600, lambda i: i % 40)  # 40 customers, four in each cell: no cell counts
    month(4, 600, lambda i: [c for c in range(200) if c // 2 % 5 < 4][i % 160])  # four groups hold .80 of the weight
    month(5, 600, lambda i: i * 2 % 200)  # one family, half of the weight
    month(6, 750, lambda i: i % 200 if i < 590 else 900 + i)  # 590 of 750 resolved
    month(7, 730, lambda i: i % 200 if i < 590 else 900 + i)  # 590 of 730 resolved
    month(8, 3, lambda i: 900 + i)  # none resolved
    got = run(
        spark, "suppression", tmp_path, region=([(0, "A"), (1, "B")], "r_regionkey int, r_name string"), nation=([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        customer=(customers, "c_custkey long, c_nationkey int, c_mktsegment string"), orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
    )
    assert {r["month"].month: r["reasons"] for r in got} == {
        1: "", 2: "LOW_SAMPLE_SIZE", 3: "LOW_ENTITY_COUNT,LOW_MATCHED_WEIGHT", 4: "LOW_GROUP_COUNT", 5: "LOW_SOURCE_COUNT,LOW_MATCHED_WEIGHT", 6: "LOW_RESOLUTION", 7: "",
        8: "LOW_SAMPLE_SIZE,LOW_ENTITY_COUNT,LOW_GROUP_COUNT,LOW_SOURCE_COUNT,LOW_RESOLUTION,LOW_MATCHED_WEIGHT",
    }
    assert {r["month"].month: r["score"] for r in got} == {k: 80.0 if k in (1, 7) else None for k in range(1, 9)}
