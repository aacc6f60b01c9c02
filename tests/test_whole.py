"""Queries whose SQL is bounded, against brute force on small tables that reach beyond the bound."""

from corvello.plans import queries as library


def test_link_closure_has_no_hop_bound(spark, tmp_path):
    # A chain p1 - s1 - p2 - s2 - ... of twelve steps, and a pair that nothing leads to.
    pairs = [(k, k) for k in range(1, 7)] + [(k + 1, k) for k in range(1, 7)] + [(99, 99)]
    spark.createDataFrame(pairs + pairs[:3], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in library.link_closure(spark, str(tmp_path)).select("node", "hop").collect())
    assert got == sorted([(f"p{k}", 2 * k - 2) for k in range(1, 8)] + [(f"s{k}", 2 * k - 1) for k in range(1, 7)])


def test_conversation_paths_has_every_turn(spark, tmp_path):
    # Turns 0 to 20, one turn 0 alone, a conversation that lacks turn 2, and a turn without a role.
    rows = [(1, t, "ab"[t % 2]) for t in range(21)] + [(2, 0, "a")] + [(3, t, "b") for t in (0, 1, 3, 4)] + [(4, 0, "a"), (4, 1, None), (4, 2, "b"), (5, None, "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.node: (r.depth, r.path) for r in library.conversation_paths(spark, str(tmp_path)).collect()}
    want = {f"1/{t}": (t, ", ".join("ab"[k % 2] for k in range(t + 1))) for t in range(21)}
    assert got == want | {"2/0": (0, "a"), "3/0": (0, "b"), "3/1": (1, "b, b"), "4/0": (0, "a"), "4/1": (1, None), "4/2": (2, None)}
