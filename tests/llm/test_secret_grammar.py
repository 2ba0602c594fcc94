import hashlib
import random
import re

from veritrail.llm import secret_grammar as sg
from veritrail.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    """The contract's rule, word for word."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def texts():
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    parts = [lambda: "Token = \"" + hexes(40) + '"', lambda: "AKIA" + upper(16), lambda: hexes(rng.randint(10, 40)),
             lambda: "AKIA" + upper(3), lambda: "api_key:" + upper(8), lambda: "secret=token: " + upper(20),
             lambda: "password'  =  " + hexes(13), lambda: "überß é日本", lambda: "thandorinationes", lambda: "toſken=abcdefghijklmnop",
             lambda: "the and of", lambda: "x" * 30]
    out = [" ".join(rng.choice(parts)() for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return out + ["", None, "é" * 5000 + " token=" + hexes(32)] + out[:5]


def test_base_spans_follow_the_rule():
    for text in filter(None, texts()):
        assert [(s, k, e) for s, k, e, _ in sg.base_spans(text)] == plain_base(text), text


def test_free_tokens_touch_no_base_secret():
    for text in filter(None, texts()):
        base = sg.base_spans(text)
        got = list(sg.free_tokens(text, base))
        want = [(m.start(), m.end(), m.group()) for m in sg.TOKEN.finditer(text)
                if not any(b[0] < m.end() and m.start() < b[2] for b in base)]
        assert got == want


def test_states_that_agree_are_merged():
    rng = random.Random(1)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)]
    tree = sg.Automaton.prefix_tree(values)
    before = len(tree.visits)
    model = tree.merged()
    assert len(model.visits) < 40 < before
    back = sg.Automaton.from_json(model.to_json())
    probe = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    assert back.log_likelihood(probe) == model.log_likelihood(probe) > -60
    assert model.log_likelihood("thandorination") == float("-inf")
    fixed = sg.Automaton.prefix_tree(["AA-1"] * 300 + ["ZZ-2-3"] * 300).merged()
    assert fixed.log_likelihood("AA-1") > -1 and fixed.log_likelihood("AA-1-2") == float("-inf")


def test_query_equals_the_rule_and_adds_formats(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    # the same format without a key word, and in a form no base pattern takes
    rows.append((9_000, "see sk-0f3c-11aa-97bd-0c4e here", "x"))
    rng = random.Random(2)
    rows += [(9_001 + i, "token = sk" + "".join(f"-{rng.randrange(65536):04x}" for _ in range(4)) + " end", "x") for i in range(120)]
    rows += [(9_500 + i, "ordinationes andthererthe " + "whereuponthe" * 2, "x") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    done = {}
    for r in QUERIES["op4_secret_grammar"](spark, str(tmp_path)).collect():
        done[r.doc_id] = r
    assert len(done) == len(rows)
    for i, text, _ in rows:
        want = plain_base(text or "")
        joined = ",".join(f"{sg.KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = done[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == ([x for x in joined.split(",") if x])
    assert done[9_000].spans == "format:4:26"
    assert done[9_501].spans == ""


def test_redact_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefabcdef0123456789 z"), (2, None), (3, "clean"), (4, "0123456789abcdef")],
                                 "doc_id long, text string")
    out = {r.doc_id: r.text for r in sg.redact(sg.find_secrets(docs)).collect()}
    assert out == {1: "a <secret> z", 2: None, 3: "clean", 4: "<secret>"}
    assert sg.find_secrets(docs.where("false")).count() == 0


def test_tokens_around_a_base_secret_are_scored_too(spark):
    rng = random.Random(4)
    key = lambda: "px_" + "".join(rng.choice("0123456789abcdef") for _ in range(16)) + "QRS"
    rows = [(i, f"token = {key()} end") for i in range(120)] + [(500, f"see {key()} here"), (501, "see ordinationes here")]
    found = sg.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert spans[500] == [("format", 4, 26), ("hex", 7, 23)] and spans[501] == []
    assert {r.doc_id: r.text for r in sg.redact(found).collect()}[500] == "see <secret> here"
    found.unpersist()
