"""A folder of small tables with every awkward row, shared by the operator tests."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LANGS = {"en": "the and of ing tion er hea th sh on", "de": "der und die ung keit sch ein ver zu ü", "fr": "le de la eau tion ment que é ç oi", "es": "el de que ción ado los ñ mente ra"}


def prose(rng, lang, n):
    parts = LANGS[lang].split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, n, 9))


def edited(rng, text, share):
    words = text.split(" ")
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = "w" + str(rng.randint(0, 10**6))
    return " ".join(words)


def documents():
    rng = random.Random(4)
    texts = [(prose(rng, lang, rng.randint(3, 260)), lang) for lang in LANGS for _ in range(28)]
    base = prose(rng, "en", 150)
    texts += [(edited(rng, base, share), "en") for share in (0.0, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.2)]
    line = "This very line, longer than forty characters, is shared by many."
    texts += [(prose(rng, "de", 30) + "\n \t" + (line.upper() if k % 2 else line) + "\n" + prose(rng, "de", 12), "de") for k in range(7)]
    passage = prose(rng, "fr", 70)
    texts += [(prose(rng, "fr", 25) + " " + passage + " " + prose(rng, "fr", 25), "fr") for _ in range(4)]
    texts += [(None, "en"), ("", "en"), (" \n\t ", None), ("12 34 !!", "de"), ("one two", "en"), ("one two", "en"), ("\n\n\n", None), ("é" * 300, "fr"), ("ab" * 400, None)]
    texts += [("x y <|endoftext|> z", "en"), ("mail bob.42@mail8.example.com or +1 (988) 555-2485, 152.143.123.131, 4111 1111 1111 1111", "en"), ("write to bob at mail8 dot example dot com today", "en")]
    texts += [(prose(rng, "en", 9000), "en"), ("aé7" * 30000, "en")]
    rows = [{"doc_id": k, "text": t, "lang": g, "source": f"src{k % 3}" if k % 5 else None, "n_chars": len(t) if t is not None else None} for k, (t, g) in enumerate(texts)]
    return rows


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def write(folder, name, table):
    pq.write_table(table, f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def small(tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("small")
    write(folder, "documents", pa.Table.from_pylist(rows, SCHEMA))
    rng = random.Random(8)
    long = [r["text"] for r in rows if r["text"] and len(r["text"].split()) > 60]
    items = [" ".join(long[3].split()[10:40]), "If Tom has 3 apples and gives 2 kg of them to Mary, how many apples does Tom have left then?", None, "", "too short"]
    write(folder, "benchmark", pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}))
    vectors = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(300)]
    vectors += [vectors[7]] * 30 + [None, [0.0] * 12, [1.0] * 5, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] * 12]
    write(folder, "embeddings", pa.table({"vec_id": pa.array([*range(len(vectors) - 1), None], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}))
    hosts = ["a.example.net", "b.EXAMPLE.net", "x.example.com", "shop.example.org", "net", "bad.io", "good.io", "1.2.3.4"]
    urls = [f"http{'s' * (k % 2)}://{hosts[k % len(hosts)]}{['/en/', '/de/x', '/fr/', '', '?q=/en/', '/en'][k % 6]}" for k in range(160)] + [None, "", "no scheme", "://", "ftp://a.b/c://d", "http://A.net#/en/"]
    write(folder, "pages", pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array([""] * len(urls))}))
    bad = [int(hosts[k % len(hosts)] == "bad.io" or k % 17 == 0) for k in range(150)]
    write(folder, "labels", pa.table({"doc_id": pa.array([*range(150), None], pa.int64()), "quality": pa.array([1 - b for b in bad] + [None], pa.int64()), "toxic": pa.array([0] * 150 + [None], pa.int64())}))
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory, small):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "embeddings", "pages", "labels"):
        write(folder, name, pq.read_table(f"{small}/{name}.parquet").slice(0, 0))
    return str(folder)
