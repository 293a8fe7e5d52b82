import random

from tallyspan.llm import conversations as cv

SCHEMA = "run_id string, sequence bigint, event_id string, event_kind string, content string, turn string, state string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_pointer_jumping_resolves_chains_orphans_and_cycles(spark):
    chain = [("a", i, i - 1 if i else None) for i in range(300)]
    orphan = [("o", 1, 99), ("o", 2, 1), ("o", 3, 2)]
    cycle = [("c", 1, 3), ("c", 2, 1), ("c", 3, 2), ("c", 4, 4)]
    tree = [("t", 1, None), ("t", 2, 1), ("t", 3, 1), ("t", 4, 3)]
    rows = chain + orphan + cycle + tree
    random.Random(1).shuffle(rows)
    got = {(r["g"], r["k"]): (r["root"], r["depth"], r["state"]) for r in cv.resolve_pointers(spark.createDataFrame(rows, "g string, k bigint, p bigint"), ["g", "k"], "p").collect()}
    assert all(got["a", i] == (0, i, "ok") for i in range(300))
    assert {got["o", i][2] for i in (1, 2, 3)} == {"orphan"} and {got["c", i][2] for i in (1, 2, 3, 4)} == {"cycle"}
    assert got["t", 4] == (1, 2, "ok") and got["t", 2][1] == 1


def test_whole_and_dropped_runs(spark):
    pair = lambda run, n=1, kinds=("user_message", "assistant"): [(run, i + 1, f"{run}{i}", kinds[i % 2], f"text {i}") for i in range(2 * n)]
    rows = pair("ok") + pair(" RUN_x\n", 2, ("User-Message", "ai"))
    rows += [("ok", 1, "ok0", "user_message", "text 0"), ("ok", 7, "tool", "tool_event", None), ("ok", 9, "nokind", None, "x")]
    rows += [*pair("gap")[:1], ("gap", 4000, "gap9", "assistant", "late")]
    rows += pair("differs") + [("differs", 1, "differs0", "user_message", "other")]
    rows += pair("nulled") + [("nulled", 1, "nulled0", "user_message", None)]
    rows += pair("shared") + [("shared", 2, "other", "tool_event", "x")]
    rows += pair("blank")[:1] + [("blank", 2, "b", "assistant", "​　 ")]
    rows += pair("noreply", 2)[:3] + [("two", 1, "a", "user", "x"), ("two", 2, "b", "user", "y"), ("two", 3, "c", "ai", "z")]
    rows += [("first", 1, "f", "ai", "x"), ("first", 2, "g", "user", "x"), (None, 1, "n", "user", "x"), (" ", 1, "m", "user", "x"), ("tools", 1, "q", "tool_event", "x"), ("ok2", None, "z", "user", "x")]
    got = sorted(tuple(r) for r in cv.conversations(frame(spark, rows)).collect())
    assert got == sorted(
        [("ok", 1, "user", "ok0"), ("ok", 2, "assistant", "ok1"), ("gap", 1, "user", "gap0"), ("gap", 2, "assistant", "gap9")]
        + [("run_x", i + 1, ("user", "assistant")[i % 2], f" RUN_x\n{i}") for i in range(4)]
    )


def test_one_run_over_many_blocks_and_empty_table(spark):
    rows = [("hot", 3 * i, f"e{i}", "user" if i % 2 == 0 else "ai", "x") for i in range(3000)]
    random.Random(2).shuffle(rows)
    got = {r["event_id"]: r["turn"] for r in cv.conversations(frame(spark, rows)).collect()}
    assert got == {f"e{i}": i + 1 for i in range(3000)}
    assert cv.conversations(frame(spark, [])).count() == 0


def test_copies_of_an_event_meet_however_far_their_sequences_lie_apart(spark):
    rows = [("far", 1, "a", "user", "x"), ("far", 2, "b", "ai", "y"), ("far", 90_000, "b", "ai", "other"), ("same", 1, "c", "user", "x"), ("same", 2, "d", "ai", "y"), ("same", 90_000, "d", "ai", "y")]
    assert {r["run_id"] for r in cv.conversations(frame(spark, rows)).collect()} == {"same"}
