"""The operators on conversations against brute force, SQL and every awkward row."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginalia.llm import prefix_trie, reply_trees, structure_repair
from marginalia.llm.count_min import cells, sketch, width_for
from marginalia.llm.oracles import DIALOGUE
from marginalia.llm.queries import QUERIES, rebuilt

SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    rng = random.Random(3)
    said = ["Yes.", "no", "Why?", "", " \t", None, "Ça va!", "a b  c.", "[INST]x</s>", "<\\s> \\ [\\\\/INST]", "Yes."]
    rows = []
    for c in range(130):
        if c % 7 == 3:  # many whole copies, and long ones
            rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"copy {k}.") for k in range(40 if c % 2 else 6)]
            continue
        for k in range(rng.choice([1, 2, 3, 4, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, rng.choice([k, k, k, None, 2]), role, rng.choice(said)))
    return rows + [rows[0], rows[0], (400, None, None, None), (-3, 1, "user", "Hi."), (420, 5, "system", "Be kind."), (421, 1, "user", "Hi.")]


@pytest.fixture(scope="module")
def talk(tmp_path_factory):
    folder = tmp_path_factory.mktemp("talk")
    rows = conversations()
    made = pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)
    made = made.append_column("path", pa.array(["clash"] * len(rows))).append_column("digest", pa.array([None] * len(rows), pa.int32())).append_column("audit", pa.array([1] * len(rows)))
    pq.write_table(made, f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def silent(tmp_path_factory):
    folder = tmp_path_factory.mktemp("silent")
    pq.write_table(pa.Table.from_pylist([], SCHEMA), f"{folder}/conversations.parquet")
    return str(folder)


def found(spark, name, folder):
    return sorted((tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES[name](spark, folder).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(DIALOGUE))
def test_queries_equal_their_sql_on_awkward_rows(spark, talk, silent, name):
    for folder in (talk, silent):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'")
        result = db.execute(DIALOGUE[name])
        columns = [d[0] for d in result.description]
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        assert found(spark, name, folder) == sorted((tuple(r[k] for k in order) for r in result.fetchall()), key=repr)


# --- reply trees ------------------------------------------------------------------------------------

def as_paths(rows, branches=None):
    """Brute force: ids from root to leaf of the best paths of every tree."""
    best = {}
    for conv, name, parent, place, _, _, score in rows:
        if name is not None:
            entry = (conv, place, parent or "", score or 0.0)
            best[name] = min(best.get(name, entry), entry, key=repr)
    up = {n: p for n, (c, at, p, _) in best.items() for p in [p] if p in best and best[p][0] == c and best[p][1] < at}
    trees = defaultdict(list)
    for leaf in set(best) - set(up.values()):
        line = [leaf]
        while line[-1] in up:
            line.append(up[line[-1]])
        trees[line[-1]].append((-sum(best[n][3] for n in line), -len(line), leaf, line[::-1]))
    return sorted(p[3] for t in trees.values() for p in sorted(t)[:branches])


def tree_rows():
    rng = random.Random(9)
    rows = [(1, "a0", None, 0, "user", "root", 1.0)]
    for k in range(1, 60):
        rows.append((1, f"a{k}", f"a{rng.randrange(max(0, k - 6), k)}", k, rng.choice(["user", "assistant", None]), rng.choice(["x</s>", "y", None, "[INST]"]), rng.choice([0.0, 0.5, -1.0, None])))
    rows += [(2, "b0", "missing", 0, "user", "q", 0.0), (2, "b1", "a3", 1, "user", "other conversation", 0.0), (2, "b2", "b3", 2, "user", "later parent", 0.0),
             (2, "b3", "b2", 3, "assistant", "z", 0.0), (None, "c0", None, 0, "user", "null id", 0.0), (None, "c1", "c0", 1, "assistant", "r", None), (3, None, None, 0, "user", "no id", 0.0)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(tree_rows(), "conv_id long, msg_id string, parent_id string, place long, role string, text string, score double").withColumn("path", F.lit("clash"))


@pytest.mark.parametrize("branches", [None, 1, 3])
def test_paths_of_trees_equal_brute_force(spark, tree, branches):
    lines = defaultdict(list)
    for r in reply_trees.paths(tree, branches).collect():
        lines[r.path].append((-r.above, r.msg_id))
    assert sorted([n for _, n in sorted(line)] for line in lines.values()) == as_paths(tree_rows(), branches)


def test_formatted_paths_read_back(spark, tree):
    said = {}
    for r in tree_rows():
        if r[1] is not None:
            said[r[1]] = min(said.get(r[1], (r[4] or "", r[5] or "")), (r[4] or "", r[5] or ""))
    made = reply_trees.format_paths(tree)
    rows = made.withColumns({"turns": reply_trees.read_turns(F.col("formatted")), "learned": reply_trees.read_loss(F.col("formatted"), F.col("loss"))}).collect()
    lines = {line[-1]: line for line in as_paths(tree_rows())}
    assert len(rows) == len(lines)
    for r in rows:
        want = [said[n] for n in lines[r.path]]
        assert [tuple(t) for t in r.turns] == want and r.n_turns == len(want)
        assert r.learned == "".join(t for role, t in want if role == "assistant")
        raw = r.formatted.encode()
        for s in r.loss:
            assert r.formatted[s.start : s.end] == raw[s.byte_start : s.byte_end].decode()
        assert r.formatted.startswith("<s>") and r.formatted.count("</s>") == len(want) and r.formatted.count("[INST]") == len(want)
    for root, ranks in itertools.groupby(sorted((r.root, r["rank"]) for r in rows), key=lambda x: x[0]):
        assert [k for _, k in ranks] == list(range(1, 1 + sum(r.root == root for r in rows)))


def test_escapes_turn_back(spark):
    texts = ["".join(p) for p in itertools.product(["<", "/", "s>", "\\", "[", "INST]", "é"], repeat=4)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, hidden, back in frame.select("t", reply_trees.escape(F.col("t")), reply_trees.unescape(reply_trees.escape(F.col("t")))).collect():
        assert back == t and not re.search(r"</?s>|\[/?INST\]", hidden)


# --- prefix trie ------------------------------------------------------------------------------------

def brute_trie(turns, ids=()):
    convs = defaultdict(list)
    for c in ids:
        convs[c]
    for c, place, role, text in turns:
        if c is not None:
            convs[c].append((place is not None, place or 0, role or "", text or ""))
    lines = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in convs.items()}
    members = defaultdict(list)
    for c, line in lines.items():
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [v for v in members if v[: len(node)] == node]
        kids = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)]
        saved = sum((len(members[v]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) for v in below if v)
        ends = ",".join(str(c) for c in sorted(own) if len(lines[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_log2", [1, 5, 24])
def test_trie_equals_brute_force_however_small_the_sketch(spark, most_log2, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE_IDS", 3)
    rng = random.Random(6)
    rows = [(c, k, r, t) for c in range(90) for k, (r, t) in enumerate([("user", "hello there"), ("assistant", "yes"), ("user", rng.choice("abc")), ("assistant", rng.choice("de ")), ("user", f"{c} end")][: rng.randrange(0, 6)])]
    rows += [(200, None, None, None), (200, None, "user", "x"), (200, 1, "user", "x"), (200, 1, "user", "x"), (None, 1, "user", "lost"), (201, 0, "user", "hello there"), (201, 0, "user", "hello there")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit(1))
    ids = spark.createDataFrame([(300,), (300,), (None,), (5,)], "conv_id long")
    made = prefix_trie.prefix_trie(turns, ids=ids, most_log2=most_log2)
    # ties go by role and a digest; equal turns of one number are rows of their own, so brute force agrees
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute_trie(rows, [300, 5])


def test_sketch_never_calls_a_repeat_single(spark):
    digests = [hashlib.sha256(str(k % 700).encode()).digest()[:16] for k in range(1000)]
    shared = sketch(spark.createDataFrame([(d,) for d in digests], "digest binary").repartition(5), 1000, most_log2=11)
    said = shared.test(pa.array(digests, pa.binary()))
    assert all(said[k] for k in range(1000) if k % 700 < 300)
    assert sum(said[300:700]) < 300
    assert width_for(10**12) == 24 and len(cells(pa.array([], pa.binary()), 5)[0]) == 0


def test_rebuilt_conversations(spark, talk):
    turns, ids = rebuilt(spark.read.parquet(f"{talk}/conversations.parquet"))
    got = defaultdict(list)
    for r in turns.collect():
        got[r.conv_id].append((r.place, r.role, r.text))
    lines = defaultdict(list)
    for c, turn, role, text in conversations():
        lines[c].append((turn is not None, turn or 0, role or "", text or ""))
    lines = {c: [x[2:] for x in sorted(v)] for c, v in lines.items()}
    assert {r.conv_id for r in ids.collect()} == set(lines)
    for c, line in lines.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - int(c / 20) * 20
        assert [x[1:] for x in sorted(got[c])] == lines.get(c - source, [])[:h] + line[h:]


# --- structure repair -------------------------------------------------------------------------------

def exhaustive(symbols):
    """The least ``(cost, audit)`` of all ways to repair a signature, by trying them."""
    best = {}

    def go(k, roles, cost, audit, run):
        if cost > 3 * len(symbols) + 12:
            return
        if k == len(symbols):
            if re.fullmatch("(s?(ua)+)?", roles):
                best["x"] = min(best.get("x", (10**9, "")), (cost, audit))
        else:
            s = symbols[k]
            go(k + 1, roles, cost + 4, audit + "D", 0)
            if s != "x":
                broken = 3 if s.isupper() else 0
                if s.lower() in "sua":
                    go(k + 1, roles + s.lower(), cost + broken, audit + "K", 0)
                for r in "ua":
                    go(k + 1, roles + r, cost + 3 + broken, audit + "R", 0)
        if run < 2:
            for r in "ua":
                go(k, roles + r, cost + 3, audit + "I", run + 1)

    go(0, "", 0, "", 0)
    return best["x"]


def test_audits_equal_exhaustive_search(spark):
    words = ["".join(w) for n in range(3) for w in itertools.product("xsuaoUA", repeat=n)] + ["".join(random.Random(k).choice("xsuaoSUAO") for _ in range(4)) for k in range(25)]
    rows = spark.createDataFrame([(w,) for w in words] * 2, "signature string").repartition(3)
    got = {r.signature: (r.cost, r.audit) for r in structure_repair.audits(rows).collect()}
    assert set(got) == set(words)
    for w in words:
        assert got[w] == exhaustive(w), w


def test_repaired_turns_follow_their_audit(spark, talk):
    turns = spark.read.parquet(f"{talk}/conversations.parquet").select("conv_id", "turn", "role", "text", F.lit("clash").alias("symbol"))
    report = structure_repair.reports(turns)
    rows = defaultdict(list)
    for r in structure_repair.repaired(turns, report).collect():
        rows[r.conv_id].append(r)
    for r in report.collect():
        own = rows[r.conv_id]
        assert [x.n for x in own] == list(range(1, len(own) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")
        assert len(r.audit.replace("I", "")) == len(r.signature)
        assert all(x.text == "" for x in own if x.edit == "I")


def test_long_conversations_stay_linear(spark):
    turns = spark.range(30000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    report = structure_repair.reports(turns).first()
    # of every third turn one assistant too many: deleting costs 4, a new user before it 3
    assert (report.cost, report.audit[:5]) == (3 * 10000, "KKIKK") and report.gaps == 0
    assert structure_repair.fingerprints(structure_repair.repaired(turns, structure_repair.reports(turns))).count() == 1
    made = prefix_trie.prefix_trie(turns)
    assert made.count() == 30001 and made.where("n_leaves <> 1 or saved_tokens <> 0").count() == 0
