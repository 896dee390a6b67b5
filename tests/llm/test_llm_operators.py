"""Every operator's query on small tables, against brute force, a reference library or SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language_id, personal_data, token_codec
from marginalia.llm.queries import ORACLES, QUERIES

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(SPACE, lower(text))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def collected(spark, name, folder):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def test_language_id(spark, small, rows):
    found = {r[0]: r[1:] for r in collected(spark, "op1_language_id", small)}
    assert len(found) == len(rows)
    right = total = 0
    for r in rows:
        held, lang, score = found[r["doc_id"]]
        assert held == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= score <= 1
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (lang == "und") == (not lettered)
        if held and lettered and r["lang"] and len(r["text"]) > 40:
            total, right = total + 1, right + (lang == r["lang"])
    assert total > 20 and right / total > 0.9


def test_code_lengths_equal_the_step_by_step_model():
    texts = [("a", "abracadabra abra"), ("b", "banana bandana ban")]
    model = language_id.learn(texts, order=3, least=1)

    def bits(lang, text):
        data, own = text.encode(), "\n".join(t for g, t in texts if g == lang).encode()
        total = 0.0
        for k, byte in enumerate(data):
            cost = 0.0
            for order in range(min(3, k), -1, -1):
                context = data[k - order : k]
                anywhere = [t for _, t in texts if any(t.encode()[j - order : j] == context for j in range(order, len(t.encode())))]
                follow = Counter(own[j] for j in range(order, len(own)) if own[j - order : j] == context)
                if not anywhere or not follow:
                    continue
                n, d = sum(follow.values()), len(follow)
                if byte in follow:
                    cost += math.log2((n + d) / follow[byte])
                    break
                cost += math.log2((n + d) / d)
            else:
                cost += 8.0
            total += cost
        return total

    import pyarrow as pa

    tests = ["abra", "banana", "zzz", "", "cab and"]
    got = language_id.code_lengths(pa.array(tests), model)
    assert np.allclose(got, [[bits(g, t) for g in model["langs"]] for t in tests], atol=1e-4)


def test_nearest(spark, small):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in table if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 12 and None not in r["embedding"]
            and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    found = defaultdict(list)
    for q, rank, v, score in sorted(collected(spark, "op2_nearest", small)):
        found[q].append((rank, v, score))
    hit = total = 0
    assert sorted(found) == [i for i in sorted(ids) if i % 20 == 0]
    for q, got in found.items():
        score = x @ x[ids == q][0]
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -score[other]))[:20]]
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(abs(s - score[ids == v][0]) < 1e-9 for _, v, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hit, total = hit + len(set(best) & {v for _, v, _ in got}), total + 20
    assert hit / total >= 0.9


def test_token_codec(spark, small, rows):
    machine = token_codec.codec(token_codec.public_files())
    found = {r[0]: r[1:] for r in collected(spark, "op3_token_codec", small)}
    assert len(found) == len(rows)
    for r in rows:
        ids = machine.reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(machine.reference.decode(ids, skip_special_tokens=False)))


def test_ids_survive_the_round_trip(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 7 = 0 or length(text) > 60000")
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    back = token_codec.decode(token_codec.encode(docs, long_text=400)).select("doc_id", "decoded").collect()
    assert back and all(r.decoded == texts[r.doc_id] for r in back)


@pytest.mark.parametrize("seed", range(4))
def test_tree_concatenation_equals_the_library(seed):
    import random

    rng = random.Random(seed)
    machine = token_codec.codec(token_codec.public_files())
    parts = ["the", "ing", "'s", "'ll", "  ", "\n\n", "<|endoftext|>", "x" * 40, "12345678901234", "!!!???", "é", "中文字", "🙂", " a", "\u0085", "\x1c"]
    for _ in range(120):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) + "".join(rng.choice("etaoin") for _ in range(rng.randint(0, 300)))
        pieces = machine.pieces(text, rng.choice([3, 7, 40]))
        assert "".join(p for _, p in pieces) == text
        ids = machine.concatenate([(k, machine.piece_ids(k, p)) for k, p in pieces])
        assert ids == machine.reference.encode(text, add_special_tokens=False).ids and machine.decode(ids) == text


def test_language_model(spark, small, rows):
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    counts = Counter()
    for r in rows:
        if not held[r["doc_id"]]:
            counts.update([*words(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    found = {r[0]: r[1:] for r in collected(spark, "op5_language_model", small)}
    assert len(found) == len(rows)
    for r in rows:
        own = [*words(r["text"]), None]
        got = found[r["doc_id"]]
        assert got[:4] == (held[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(got[4], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert got[5] < 0


def test_attention_model_is_a_distribution_and_gradients_are_right():
    from marginalia.llm import language_model as lm

    model = lm.train(["the cat sat on the mat. " * 40, "a dog sat on the log. " * 40], token_codec.public_files(), steps=60)
    w, mask = model["weights"], lm.causal_mask()
    inputs = np.zeros((1, lm.WINDOW), int)
    hidden, _ = lm.attend(w, inputs, mask)
    logits = hidden[0, -1] @ w["klass"] + w["klass_bias"]
    klass = np.exp(logits) / np.exp(logits).sum()
    member = np.stack([np.exp(x) / np.exp(x).sum() for x in np.einsum("d,cdm->cm", hidden[0, -1], w["member"]) + w["member_bias"]])
    assert math.isclose((klass[:, None] * member).sum(), 1, rel_tol=1e-4)
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, 60, (2, lm.WINDOW)), rng.integers(0, 60, (2, lm.STRIDE))
    targets[1, 5:] = -1
    exact = {k: x.astype(np.float64) for k, x in w.items()}

    def loss():
        h, _ = lm.attend(exact, inputs, mask.astype(np.float64))
        total = count = 0
        for row, own in zip(h.reshape(-1, lm.WIDTH), targets.reshape(-1), strict=True):
            if own >= 0:
                c, m = divmod(int(own), lm.MEMBERS)
                for logits, k in ((row @ exact["klass"] + exact["klass_bias"], c), (row @ exact["member"][c] + exact["member_bias"][c], m)):
                    total -= logits[k] - np.log(np.exp(logits).sum())
                count += 1
        return total / count

    grads = lm.gradients(exact, inputs, targets, mask.astype(np.float64))
    for name, at in (("embed", (int(inputs[0, 0]), 3)), ("q", (1, 2)), ("k", (3, 0)), ("v", (2, 2)), ("o", (0, 4)), ("place", (20, 1)), ("klass", (5, 1)), ("member", (1, 2, 3))):
        old = exact[name][at]
        exact[name][at] = old + 1e-5
        up = loss()
        exact[name][at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        exact[name][at] = old
        assert math.isclose(slope, grads[name][at], rel_tol=2e-3, abs_tol=1e-6), name


def test_attention_equals_keys_and_values_apart_and_places_come_class_by_class():
    from marginalia.llm import language_model as lm

    rng = np.random.default_rng(2)
    w = {k: x.astype(np.float64) for k, x in lm.untrained(np.arange(900))["weights"].items()}
    w |= {k: rng.normal(0, 0.5, w[k].shape) for k in ("klass", "member", "klass_bias", "member_bias")}
    inputs, target = rng.integers(0, 900, (3, lm.WINDOW)), rng.integers(-1, 900, 3 * lm.STRIDE)
    hidden, _ = lm.attend(w, inputs, lm.causal_mask().astype(np.float64))
    order, own, klass, member, spans = lm.by_class(hidden.reshape(-1, lm.WIDTH), target)
    outer, inner = lm.heads(w)
    assert sorted(order) == list(np.flatnonzero(target >= 0)) and sum(at.stop - at.start for _, at in spans) == len(order)
    for place, row, k, m in zip(order, own, klass, member, strict=True):
        window, query = divmod(int(place), lm.STRIDE)
        x = (w["embed"][inputs[window]] + w["place"])[: lm.WINDOW - lm.STRIDE + query + 1]
        weight = np.exp((x @ w["k"]) @ (x[-1] @ w["q"]) / lm.WIDTH**0.5)
        state = np.tanh(x[-1] + (weight / weight.sum()) @ (x @ w["v"]) @ w["o"])
        assert np.allclose(row, [*state, 1]) and divmod(int(target[place]), lm.MEMBERS) == (k, m)
        assert np.allclose(row @ outer, state @ w["klass"] + w["klass_bias"]) and np.allclose(row @ inner[k], state @ w["member"][k] + w["member_bias"][k])
    assert all((klass[at] == c).all() for c, at in spans)


def test_language_model_bounds_the_batches_that_go_to_python(spark):
    from marginalia.llm import language_model as lm

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").repartition(2, "doc_id")
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in lm.score(docs, F.lit(True)).collect()) == [(1, 3, 3), (2, 1, 1)]  # a batch may hold no word at all
    assert int(spark.conf.get(name)) == 1 << 21 and lm.SCORED_AT_ONCE <= 1 << 17
    spark.conf.unset(name)


def test_attention_model_learns_from_all_training_texts(spark):
    from marginalia.llm import language_model as lm

    long = "zebra quartz violin " * 60_000  # more than the sample of the first weights may hold
    docs = spark.createDataFrame([(0, long), *((k, "the cat sat on the mat. " * 20) for k in range(1, 30)), (50, "zebra quartz violin " * 400), (51, "the cat sat on the mat. " * 20)], "doc_id int, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 50).collect()}
    assert len(long) > lm.SAMPLE_BYTES and len(got) == 32
    for k in (50, 51):
        assert got[k].score / got[k].n_tokens > -1, (k, got[k])
    assert abs(got[1].score - got[29].score) < 1e-6 * abs(got[1].score)


def test_ids_without_an_output_share_the_rest_by_their_counts():
    from marginalia.llm import language_model as lm

    counts = np.maximum(0, 3000 - np.arange(50_257))
    model = lm.counted(counts, 10)
    other = model["lookup"][:-1] == lm.OTHER
    assert other.sum() == 50_257 - 1022 and math.isclose(np.exp(model["rest"][:-1][other]).sum(), 1, rel_tol=1e-9)
    assert model["rest"][1500] > model["rest"][2900] > model["rest"][40_000] and model["rest"][5] == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if j % 2 == 0 else sum(divmod(2 * int(d), 10)) for j, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, small, rows):
    found = {r[0]: r[1:] for r in collected(spark, "op6_personal_data", small)}
    assert len(found) == len(rows)
    for r in rows:
        own = base_spans(r["text"] or "")
        got = found[r["doc_id"]]
        assert got[:4] == tuple(sum(k == kind for _, k, _ in own) for kind in range(4))
        listed = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in own]
        assert got[4] == sha(",".join(listed)) and set(listed) <= set(got[5].split(",")) | {""}
    spelt = next(r["doc_id"] for r in rows if r["text"] and r["text"].startswith("write to bob"))
    assert found[spelt][5].startswith("email:9:")


def test_random_field_on_unseen_rows():
    model = personal_data.train(personal_data.labelled_table())
    right = wrong = missed = 0
    for text, spans in personal_data.labelled_table(seed=77, per_template=5):
        got = {(a, personal_data.KINDS[k], b) for a, k, b in personal_data.model_spans([text], model)[0]}
        want = {(a, kind, b) for a, b, kind in spans}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9


def test_cutting_sequences_changes_no_span():
    model = personal_data.train(personal_data.labelled_table())

    def uncut(text):
        found = [(m[0], m.start(), m.end()) for m in personal_data._WORD.finditer(text)]
        starts, ends = np.array([f[1] for f in found]), np.array([f[2] for f in found])
        path = personal_data.viterbi(model, [personal_data.features([f[0] for f in found], starts, ends)])[0]
        out = []
        for a in np.flatnonzero(path % 2 == 1):
            b = a
            while b + 1 < len(path) and path[b + 1] == path[a] + 1:
                b += 1
            kind = int(path[a] - 1) // 2
            if personal_data.passes(personal_data.KINDS[kind], text[starts[a] : ends[b]]):
                out.append((int(starts[a]), kind, int(ends[b])))
        return out

    plain = "so it goes on and on with many plain words that say nothing at any length of it all "
    for seed in (11, 77):
        for text, _ in personal_data.labelled_table(seed):
            for own in (text, plain + text + " " + plain):
                assert personal_data.model_spans([own], model)[0] == uncut(own), own


def test_decontamination(spark, small, rows):
    from marginalia.llm import decontamination

    found = {r[0]: r[2] for r in collected(spark, "op4_decontamination", small)}
    assert len(found) == len(rows)
    source = next(r for r in [x for x in rows if x["text"] and len(x["text"].split()) > 60][3:4])
    assert 0 in found[source["doc_id"]] and sum(bool(x) for x in found.values()) < 12
    docs = spark.createDataFrame([
        (1, "So: if Ann has 7 apples and gives 4 lb of them to Bob, how many apples does Ann have left then? Yes."), (2, "So: if Ann has 7 apples and gives 4 lb of them to Bob, how many apples does Sue have left then?"),
        (3, "IF TOM HAS 3 APPLES AND GIVES 2 KG OF THEM TO MARY, HOW MANY"), (4, "A clean text about apples and the number 3."), (5, None)], "doc_id int, text string")
    judged = decontamination.judge(docs.withColumn("items", docs.text), spark.read.parquet(f"{small}/benchmark.parquet"))
    got = {r.doc_id: list(r["items"]) for r in judged.collect()}
    assert got == {1: [1], 2: [], 3: [1], 4: [], 5: []}


def test_url_filter_equals_its_sql(spark, small):
    got = sorted(collected(spark, "op7_host_reputation", small))
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    assert got == sorted(db.execute(ORACLES["op7_host_reputation"].replace("regexp_extract(host, '([^.]*\\.)?[^.]*$')", "regexp_extract(host, '([^.]*[.])?[^.]*$')")).fetchall())
    verdicts = {(r[1], r[4]) for r in got if r[3] is None}
    assert ("bad.io", "block") in verdicts and ("good.io", "allow") in verdicts
    assert {r[2] for r in got if r[1] == "a.b"} == {"/c://d"}


def test_line_dedup_equals_its_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted(collected(spark, "op8_line_dedup", small))
    assert got == sorted(db.execute(ORACLES["op8_line_dedup"]).fetchall()) and sum(r[2] for r in got) == 6


def test_repeated_spans(spark, small, rows):
    found = {r[0]: r[1:] for r in collected(spark, "op9_repeated_spans", small)}
    seen = set()
    assert len(found) == len(rows)
    for r in rows:
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            string = data[k : k + 100]
            if string in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert found[r["doc_id"]] == (len(data), len(data) - len(kept), spans, sha(kept)), r["doc_id"]


def shingle_sets(rows):
    sets = {}
    for r in rows:
        own = words(r["text"])
        sets[r["doc_id"]] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()}
    return sets


def classes_of(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_dedup(spark, small, rows):
    sets = shingle_sets(rows)
    want = classes_of(sets)
    found = {r[0]: r[1:] for r in collected(spark, "op10_near_dedup", small)}
    assert found == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want)


def test_components_of_chains_and_stars(spark):
    from marginalia.llm.components import components

    edges = [(k + 1, k) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(300, 200), (200, 300), (5, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 300: 200}


def test_twice_filter_misses_no_repeat(spark):
    from marginalia.llm import twice_filter

    rng = np.random.default_rng(3)
    single, repeated = (rng.integers(0, 1 << 63, n, dtype=np.int64) for n in (4000, 500))
    rows = spark.createDataFrame([(int(x),) for x in [*single, *repeated, *repeated]], "h long").repartition(7)
    seen = twice_filter.build(rows, lambda batch: batch.column(0).to_numpy().view(np.uint64).copy(), 5000)
    assert seen.test(repeated.view(np.uint64)).all() and seen.test(single.view(np.uint64)).mean() < 0.02


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert collected(spark, name, empty) == []


def test_words_with_one_polynomial_hash_stay_apart(spark):
    import pyarrow as pa

    from marginalia.llm import arrow_text, near_dedup

    # of all sums over powers of any odd number modulo 2**64, these two have the same
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    hashes, _ = arrow_text.words(pa.array([one, two, one.upper(), f" {one}\t"]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2] == hashes[3]
    docs = spark.createDataFrame([(1, f"p q r u {one}"), (2, f"p q r u {two}"), (3, f"P q r u {one} ")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_search_probes_on_until_all_ranks_are_held(spark):
    from marginalia.llm import nearest

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (192, 16)) * 10
    vectors = np.repeat(centres, 10, axis=0) + rng.normal(0, 0.001, (1920, 16))
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in nearest.search(rows).collect():
        found[r.query_id].append(r["rank"])
    assert {q: sorted(ranks) for q, ranks in found.items()} == {q: list(range(1, 21)) for q in range(0, 1920, 20)}
