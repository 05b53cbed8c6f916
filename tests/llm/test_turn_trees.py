import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from sitemill.llm import turn_trees as T
from sitemill.llm.queries import OP12_SQL

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def print_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), print_of(role, text), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    table = T.prefix_nodes(spark.createDataFrame(rows, SCHEMA), **how)
    assert table.columns == FIELDS
    return sorted(map(tuple, table.collect()), key=str)


def made(seed, convs, turns, kinds):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), "é" * rng.randint(0, kinds)) for c in convs for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("segment, shard_turns", [(1024, 200_000), (3, 7), (2, 1)])
def test_nodes_equal_brute_force(spark, segment, shard_turns):
    rows = made(1, range(0, 60), 12, 2)
    assert found(spark, rows, segment=segment, shard_turns=shard_turns) == plain(rows)


def test_copies_and_one_very_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(5, 45) for t in range(4)]
    rows += [(100, t, "user", f"t{t % 3}") for t in range(300)]
    assert found(spark, rows, segment=16, shard_turns=50) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "a"), (0, None, "user", "a"), (0, 1, None, None), (0, 1, "user", ""), (1, 0, None, "b"), (1, 0, "x", None),
        (None, 0, "user", "lost"), (3, 7, "user", "long " * 40000), (6, 0, "u", "only"), (7, 0, "u", "only"), (12, 3, "1:u", "x"), (13, 3, "u", "1:ux"),
    ]
    assert found(spark, rows) == plain(rows)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS position", "2 AS seg", "3 AS k", "4 AS ends", "5 AS size")
    assert sorted(map(tuple, T.prefix_nodes(table).collect()), key=str) == plain(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "a")]) == []


def test_sql_states_the_same(spark):
    rows = [*made(2, range(0, 40), 9, 2), (3, None, None, None), (3, 2, "user", None)]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        names = [c[0] for c in db.execute(OP12_SQL).description]
        stated = db.execute(f"SELECT {', '.join(FIELDS)} FROM ({OP12_SQL})").fetchall()
    assert sorted(names) == sorted(FIELDS)
    assert sorted(stated, key=str) == plain(rows)


def test_search_trees_are_balanced():
    tree = T.Tree()
    stops = tree.insert_all([[i] for i in range(1023)], [[1]] * 1023)
    assert len(set(stops)) == 1023

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.equal[0]) == 10


def test_lists_of_ids_are_hashed_in_pieces(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', concat('b', id)) AS ends", "id * 7 - 100 AS conv_id")
    got = {r["ends"]: r["ends_sha256"] for r in T.end_hashes(rows, piece=200).collect()}
    assert len(got) == 1 + 5000 - 1667
    assert got["a"] == hashlib.sha256(",".join(str(i * 7 - 100) for i in range(0, 5000, 3)).encode()).hexdigest()
