import random

from wakeline import session
from wakeline.operators import graph

EDGES = "run_id string, consumer string, producer string"


def edges(spark, pairs, run="r"):
    return spark.createDataFrame([(run, c, p) for p, c in pairs], EDGES)


def entries(spark, rows, run="r"):
    return spark.createDataFrame([(s, run, t) for s, t in rows], "subject string, run_id string, task string")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def closure(pairs, starts):
    seen, stack = set(starts), list(starts)
    while stack:
        node = stack.pop()
        for p, c in pairs:
            if p == node and c not in seen and p not in ("EXTERNAL", None):
                seen.add(c)
                stack.append(c)
    return seen


def test_external_null_and_self_edges_are_not_followed(spark):
    rows = edges(spark, [("EXTERNAL", "a"), (None, "a"), ("a", "a"), ("a", "b"), ("a", "b")])
    assert got(graph.forward_edges(rows), "task", "next") == [("a", "b")]


def test_ladder_of_diamonds_and_a_cycle(spark):
    ladder = [(f"n{i:02}", f"{side}{i:02}") for i in range(12) for side in "lr"]
    ladder += [(f"{side}{i:02}", f"n{i + 1:02}") for i in range(12) for side in "lr"] + [("n12", "n00")]
    assert graph.reach(entries(spark, [("s", "n00")]), edges(spark, ladder)).count() == 37


def test_pool_is_shared_and_own_work_is_exclusive(spark):
    pool = edges(spark, [("a", "a1"), ("b", "b1"), ("a1", "pool"), ("b1", "pool"), ("pool", "end")])
    starts = entries(spark, [("A", "a"), ("B", "b")])
    radius = graph.blast_radius(graph.reach(starts, pool))
    assert got(radius.where("exclusive"), "subject", "task") == [("A", "a"), ("A", "a1"), ("B", "b"), ("B", "b1")]
    summary = {r.subject: (r.entry, r.affected, r.exclusive, r.shared) for r in graph.reach_summary(starts, radius).collect()}
    assert summary == {"A": (1, 4, 2, 2), "B": (1, 4, 2, 2)}


def test_sole_subject_is_what_the_closure_says_on_random_graphs_with_cycles(spark):
    rng, pairs, starts = random.Random(7), [], []
    expected = {}
    for run in range(12):
        nodes = [f"t{i}" for i in range(10)]
        own = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)]
        mine = [(f"S{rng.randrange(4)}", rng.choice(nodes)) for _ in range(4)]
        pairs += [(f"r{run}", c, p) for p, c in own]
        starts += [("k", s, f"r{run}", t) for s, t in mine]
        for s in {s for s, _ in mine}:
            for node in closure([e for e in own if e[0] != e[1]], [t for x, t in mine if x == s]):
                expected.setdefault((f"r{run}", node), set()).add(s)
    df = graph.sole_subject(spark.createDataFrame(starts, "kind string, subject string, run_id string, task string"),
                            spark.createDataFrame(pairs, EDGES))
    found = {(r.run_id, r.task): r.subject for r in df.collect()}
    assert found == {k: (min(v) if len(v) == 1 else None) for k, v in expected.items()}


def test_evidence_path_is_the_first_a_sorted_breadth_first_walk_finds(spark):
    rng, expected, pairs, starts = random.Random(3), {}, [], []
    for run in range(12):
        # Names of different lengths, one the start of another.
        nodes = ["a", "ab", "a b", "b", "b/1", "b-1", "c", "é", "z"]
        own = [(p, c) for p, c in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(16)) if p != c]
        begin = rng.sample(nodes, 2)
        pairs += [(f"r{run}", c, p) for p, c in own]
        starts += [("s", f"r{run}", t) for t in begin]
        parent, queue = {n: None for n in begin}, sorted(begin)
        for node in queue:
            for nxt in sorted({c for p, c in own if p == node}):
                if nxt not in parent:
                    parent[nxt] = node
                    queue.append(nxt)
        for node in parent:
            path = [node]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            expected[(f"r{run}", node)] = path[::-1]
    df = graph.evidence_paths(spark.createDataFrame(starts, "subject string, run_id string, task string"), spark.createDataFrame(pairs, EDGES))
    assert {(r.run_id, r.task): list(r.path) for r in df.collect()} == expected


def test_runs_do_not_touch(spark):
    both = edges(spark, [("a", "b")], "r1").unionByName(edges(spark, [("b", "c")], "r2"))
    assert got(graph.reach(entries(spark, [("s", "a")], "r1"), both), "task") == [("a",), ("b",)]


def test_many_subjects_share_a_row_of_a_task(spark, monkeypatch):
    rng = random.Random(11)
    nodes = [f"t{i}" for i in range(40)]
    pairs = [(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(70)) if a != b]
    starts = [(f"S{i:03}", rng.choice(nodes)) for i in range(150) for _ in range(2)] + [("S000", "lonely"), ("S001", "lonely"), ("S002", "single")]
    want = {(s, t) for s in {s for s, _ in starts} for t in closure(pairs, [n for x, n in starts if x == s])}
    held = {t: {s for s, n in want if n == t} for _, t in want}
    for words in (16, 1):
        monkeypatch.setattr(graph, "WORDS", words)
        found = graph.Closure(entries(spark, starts), graph.numbered(edges(spark, pairs)))
        assert found.words == min(3, words)
        assert {tuple(r) for r in found.reached().select("subject", "task").collect()} == want
        radius = found.radius().collect()
        assert len(radius) == len(want) and all(r.exclusive == (len(held[r.task]) == 1) for r in radius)


def test_rows_of_a_round_do_not_follow_the_subjects(spark):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(4)] + [(f"a{i}", f"b{i}") for i in range(5)]
    rounds = [graph.Closure(entries(spark, [(f"S{i}", "a0") for i in range(n)]), graph.numbered(edges(spark, pairs))).rounds for n in (1, 60)]
    assert rounds[0] == rounds[1] and rounds[0][:3] == [1, 2, 2]


def test_paths_of_more_levels_than_a_key_keeps(spark):
    # Two ways at every level; names are dealt so that the smaller way changes from level to level.
    rng, depth = random.Random(5), 2 * graph.LEVELS + 3
    names = [[f"{rng.randrange(10**6):06}" for _ in range(3)] for _ in range(depth + 1)]
    pairs = [(a, b) for up, down in zip(names, names[1:]) for a in up for b in down if rng.random() < 0.7 or a == up[0]]
    best = {n: [n] for n in names[0]}
    expected, level = dict(best), best
    while level:
        arriving = {}
        for p, c in pairs:
            if p in level and c not in expected:
                arriving[c] = min(arriving.get(c, [chr(0x10ffff)]), level[p] + [c])
        expected |= arriving
        level = arriving
    df = graph.evidence_paths(entries(spark, [("s", n) for n in names[0]] + [("s", "alone")]), edges(spark, pairs))
    assert {r.task: list(r.path) for r in df.collect()} == expected | {"alone": ["alone"]}
    assert {r.task: r.hops for r in df.collect()}[names[depth][0]] == depth


def test_a_path_is_written_once_however_many_levels(spark, monkeypatch):
    deep, written = 20, []
    add = session.RoundLog.add
    monkeypatch.setattr(session.RoundLog, "add", lambda self, df: (lambda made: written.append(made[1] if "path" in df.columns else 0) or made)(add(self, df)))
    line = edges(spark, [(f"t{i:02}", f"t{i + 1:02}") for i in range(deep)])
    found = {(r.subject, r.task): r.path for r in graph.evidence_paths(entries(spark, [("s", "t00"), ("u", "t05")]), line).collect()}
    assert found[("s", "t20")] == [f"t{i:02}" for i in range(21)] and found[("u", "t20")] == [f"t{i:02}" for i in range(5, 21)]
    assert sum(written) == len(found) == 37
