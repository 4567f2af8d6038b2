import random
from collections import Counter

import pytest

from lexigraph.operators import graph, linalg
from lexigraph.sources import scratch
from lexigraph.sources import text as files

NINE = [(3, 1), (4, 1), (1, 2), (2, 2), (3, 2), (4, 3), (1, 3), (1, 4), (3, 4)]
MATRIX = "1 1 .5\n1 2 .5\n2 3 .5\n2 4 .5\n3 1 .5\n3 2 .5\n4 2 .5\n4 3 .5".split("\n")
VECTOR = ["1 0.1", "2 0.2", "3 0.3", "4\t0.4"]


def edges(spark, pairs, kind="int"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def test_stochastic_matrix(spark):
    cells = graph.stochastic_matrix(edges(spark, NINE))
    got = {(r.i, r.j): r.a for r in cells.collect()}
    third = 1 / 3
    assert got == {(4, 1): third, (3, 1): third, (2, 1): third, (2, 2): 1.0, (4, 3): third, (2, 3): third, (1, 3): third, (3, 4): 0.5, (1, 4): 0.5}
    assert linalg.is_stochastic(cells) and not linalg.is_stochastic(cells.where("i <> 2"))
    lines = {r.value for r in files.matrix_lines(cells).collect()}
    assert "4 1 0.3333333333333333" in lines and "2 2 1.0" in lines


def test_parallel_edges_stay(spark):
    got = sorted((r.i, r.j, r.a) for r in graph.stochastic_matrix(edges(spark, [(1, 2), (1, 2), (1, 3), (1, 1)])).collect())
    assert got == [(1, 1, 0.25), (2, 1, 0.25), (2, 1, 0.25), (3, 1, 0.25)]


def product(spark, cells, vector, **options):
    rows = spark.createDataFrame([(x,) for x in [*cells, *vector]], "value string")
    return {r.i: r.x for r in linalg.matvec(files.parse_matrix(rows), files.parse_vector(rows), **options).collect()}


def test_matvec(spark):
    got = product(spark, MATRIX, VECTOR)
    assert got == pytest.approx({1: 0.15, 2: 0.35, 3: 0.15, 4: 0.25}, abs=1e-15)
    rows = spark.createDataFrame([(i, x) for i, x in got.items()], "i int, x double")
    assert linalg.total(rows).first().total == pytest.approx(0.9)


def test_missing_and_repeated_entries(spark):
    assert product(spark, ["1 9 .5"], ["1 1"]) == {1: 0.0}  # a column without an entry: the row stays
    assert product(spark, ["1 1 .5"], ["1 1", "7 1"]) == {1: 0.5}  # an entry without a column: nothing
    assert product(spark, ["1 1 .5", "1 1 .5"], ["1 1"]) == {1: 0.5}
    assert product(spark, ["1 1 .5", "1 1 .5"], ["1 1"], duplicates="sum") == {1: 1.0}
    assert product(spark, [], ["1 1"]) == {}
    assert product(spark, [f"2 {k} .25" for k in range(4)], [f"{k} 1" for k in range(4)]) == {2: 1.0}


CASES = [
    (NINE, NINE),
    ([(1, 2), (2, 3)], []),
    ([(1, 2), (2, 1), (2, 3), (3, 4)], [(1, 2), (2, 1)]),
    ([(1, 1), (1, 2)], []),
    ([(1, 2), (2, 2)], [(1, 2), (2, 2)]),
    ([(1, 1), (1, 1)], [(1, 1), (1, 1)]),
    ([(1, 2), (2, 1), (3, 3)], [(1, 2), (2, 1)]),
    ([(1, 1)], []),
    ([], []),
]


@pytest.mark.parametrize("given,left", CASES)
def test_remove_dead_ends(spark, given, left):
    assert Counter(map(tuple, graph.remove_dead_ends(edges(spark, given)).collect())) == Counter(left)


def test_single_loop_in_compat_mode(spark):
    assert [tuple(r) for r in graph.remove_dead_ends(edges(spark, [(1, 1)]), compat=True).collect()] == [(1, 1)]


def test_string_ids_compare_exactly(spark):
    got = graph.remove_dead_ends(edges(spark, [("a", "A"), ("A", "a")], "string")).collect()
    assert len(got) == 2


def pruned(pairs):
    while True:
        out, into, loops = Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(a for a, b in pairs if a == b)
        alive = {n for n in out if not (out[n] == into[n] == loops[n] == 1)}
        left = [e for e in pairs if e[1] in alive]
        if len(left) == len(pairs):
            return pairs
        pairs = left


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    for n in (6, 12, 30):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * 1.3))]
        got = graph.remove_dead_ends(edges(spark, pairs))
        assert Counter(map(tuple, got.collect())) == Counter(pruned(pairs))
        assert {r.node for r in graph.dead_end_nodes(got).collect()} == set()
    degrees = {r.node: (r.in_deg, r.out_deg, r.loops) for r in graph.node_degrees(edges(spark, [(1, 1), (1, 2), (1, 2)])).collect()}
    assert degrees == {1: (1, 3, 1), 2: (2, 0, 0)}


def test_cells_move_to_partitions_of_bounded_size_before_they_are_summed(spark, tmp_path):
    spark.range(60_000).selectExpr("id % 500 as i", "id % 700 as j", "cast(1 as double) as a").write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    plan = linalg.collapsed(cells)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("partial_max") < plan.index("Exchange")  # a plan's last step comes first
    assert linalg.collapsed(cells).count() == 3500
    size = sum(f.stat().st_size for f in (tmp_path / "cells").glob("*.parquet"))
    assert scratch.dealt(cells, "i", each=size // 50).rdd.getNumPartitions() in range(45, 56)
    assert scratch.dealt(cells, "i", each=size).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
