import hashlib
import random
import re

from pyspark.sql import functions as F

from seatward.llm.secrets import base_spans, scan, scan_secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def brute(text):
    """The base patterns as stated, one by one."""
    kinds = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m.group(2)) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
    ]
    out = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(out)]


def texts(n):
    rng = random.Random(9)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "API", "ſecret", "toKen", "=", ":", " ", '"', "'", "\n", "AKIA", KEY, "é🙂",
            "0123456789abcdef" * 2, "deadbeef", "abc", "Zx9/+_.-", "client_id=", "https://host/x", "wJalrXUtnFEMI/K7MDENG", "\n\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_base_spans_against_the_plain_patterns():
    for text in texts(1500):
        want = brute(text)
        row = scan(text)
        assert row[:3] == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert row[3] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row[4].split(","))
        assert [(f["first"], f["last"]) for f in row[5]] == sorted((f["first"], f["last"]) for f in row[5]) or len(row[5]) > 1


def kinds(text):
    return [f["kind"] for f in scan(text)[5]]


def test_weak_parts_need_their_complement():
    weak = "wJalrXUtnFEMI/K7MDENGbPxRfiCY"
    assert kinds(f"some {weak} alone") == []
    assert kinds(f"id {KEY} key {weak} end") == ["access", "mixed"]
    assert kinds(f"id {KEY}\n\nother paragraph {weak}") == ["access"]
    assert kinds(f"id {KEY} {'far ' * 200} {weak}") == ["access"]
    assert kinds("client_id=svc-17 and nothing else") == []
    assert kinds("client_id=svc-17 password=hunter2hunter2") == ["client", "assign"]
    assert kinds(f"client_id=svc-17 key {weak}") == ["client", "mixed"]
    assert kinds("see https://example.com/a here") == []
    assert kinds("https://example.com/a client_id=svc-17 password=hunter2hunter2") == ["endpoint", "client", "assign"]
    assert scan(f"id {KEY} key {weak} end")[5][1]["linked_to"] == 3


def test_many_parts_stay_fast_and_null_is_empty():
    text = ("client_id=svc-17 wJalrXUtnFEMI/K7MDENGbPxRfiCY https://h/x " * 3000).strip()
    assert len(scan(text)[5]) == 9000
    assert scan(None) == scan("") and scan("")[4] == "" and base_spans("a" * 100_000) == [(0, 2, 100_000)]


def test_on_tables(docs_df):
    df = docs_df([(1, None), (2, f"x {KEY}"), (2, f"x {KEY}"), (None, "é" * 50_000 + " token = 'abcdefgh1'")]).withColumn("spans", F.lit(0))
    got = sorted(((r["doc_id"], r["n_access"], r["spans"]) for r in scan_secrets(df).collect()), key=str)
    assert got == [(1, 0, ""), (2, 1, "access:2:22"), (2, 1, "access:2:22"), (None, 0, "assign:50001:50019")]
    assert scan_secrets(docs_df([])).count() == 0


def test_the_scope_alone_decides(docs_df):
    weak = "wJalrXUtnFEMI/K7MDENGbPxRfiCY"
    texts = {
        1: f"id {KEY} {'far ' * 300} {weak}", 2: f"aws_id: {KEY}\n\naws_key: {weak}", 3: f'{{"id": "{KEY}",\n\nsome text\n\n"k" "{weak}"}}',
        4: f"id {KEY}\n\n{weak} starts the next paragraph", 5: f"{{ id {KEY}\n\nnever closed {weak}",
    }
    got = {r["doc_id"]: [f["kind"] for f in r["found"]] for r in scan_secrets(docs_df(list(texts.items()))).collect()}
    assert got == {1: ["access", "mixed"], 2: ["access", "mixed"], 3: ["access", "mixed"], 4: ["access"], 5: ["access"]}
    many = "client_id=svc-17 wJalrXUtnFEMI/K7MDENGbPxRfiCY https://h/x " * 3000
    assert len(scan(many, None)[5]) == 9000
