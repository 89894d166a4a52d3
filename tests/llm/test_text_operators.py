"""URL filter, token counts, personal data, toxicity, formats, against plain versions."""

import hashlib
import json
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from blotter.llm import chat_format, pii, token_counts, toxicity, url_filter
from blotter.llm.queries import QUERIES, URL_RULES

DOCS = "doc_id long, text string"


# --- URLs --------------------------------------------------------------------------


def test_longest_rule_wins(spark):
    rules = [*URL_RULES, url_filter.Rule("block", "a.org", "/x"), url_filter.Rule("allow", "a.org", "/x/y")]
    cases = {
        "http://example.com/en/1": ("block", "example.com/en/"),
        "http://WWW.Example.com/en/1?q#f": ("allow", "www.example.com/en/"),
        "http://m.example.com/fr/": ("allow", "com/"),
        "http://a.net/es/": ("block", "net/es/"),
        "http://a.net/es": ("allow", None),
        "http://notnet/es/": ("allow", None),
        "http://example.com": ("allow", None),
        "http://example.com:80/en/": ("allow", None),
        "https://b.a.org/xyz": ("block", "a.org/x"),
        "https://b.a.org/x/yes": ("allow", "a.org/x/y"),
        "no scheme.com/en/": ("allow", None),
        "": ("allow", None),
        None: ("allow", None),
    }
    pages = spark.createDataFrame(
        [(i, u, "h", "r") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string"
    )
    for block in (1000, 2):
        rows = url_filter.judge_urls(pages, rules, trie_rules=block).orderBy("page_id").collect()
        assert [(r["verdict"], r["rule"]) for r in rows] == list(cases.values())
    assert rows[1]["host"] == "www.example.com" and rows[1]["path"] == "/en/1"
    assert rows[-1]["host"] == rows[-1]["path"] == ""
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, []).filter("rule is not null").count() == 0


def test_block_wins_a_tie_and_bad_rules_are_refused():
    both = [url_filter.Rule("block", "a.b", "/"), url_filter.Rule("allow", "a.b", "/")]
    for rules in (both, both[::-1]):
        assert url_filter.UrlTrie(rules).find("c.a.b", "/d")[0].verdict == "block"
    with pytest.raises(ValueError):
        url_filter.UrlTrie([url_filter.Rule("maybe", "a.b", "/")])


def test_very_long_and_repeated_urls(spark):
    long = "http://" + "a." * 30_000 + "example.com/en/" + "x/" * 30_000 + "?" + "q" * 50_000
    urls = [long, long, "http://example.com/en/"] * 2
    pages = spark.createDataFrame([(i % 3, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == 6 and {r["verdict"] for r in rows} == {"block"}
    whole = [r for r in rows if len(r["path"]) > 10]
    assert len(whole) == 4 and whole[0]["path"].endswith("x/") and len(whole[0]["path"]) == 4 + 60_000


# --- token counts ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.TOKENIZER)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    made = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def test_counts_are_the_tokenizers(spark, sf_dir, tokenizer):
    rows = duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    assert found == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_counts_of_odd_texts(spark, tokenizer):
    rng = random.Random(3)
    texts = ["", " ", "  a ", "▁x", "日本語 テスト", "a" * 3000, "日" * 50, "\U0001f600 ok\n\n\t"]
    texts += ["".join(rng.choices("ab é日\n.▁ 😀xyz", k=40)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    counted = token_counts.count_tokens(docs, token_counts.load_vocabulary())
    found = [r["n_tokens"] for r in counted.orderBy("doc_id").collect()]
    assert found == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    odd = spark.createDataFrame([(None, None), (1, None), (1, None)], DOCS)
    rows = token_counts.count_tokens(odd, token_counts.load_vocabulary()).collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 0]
    assert token_counts.count_tokens(odd.limit(0), token_counts.load_vocabulary()).count() == 0


def test_ties_go_to_the_longest_last_piece():
    """``ab|c`` and ``a|bc`` have equal sums; the pieces differ in number below them."""
    vocabulary = token_counts.Unigram({"▁": 0.0, "a": -1, "b": -1, "c": -1, "ab": -2, "abc": -3, "bc": -2}, -3)
    assert token_counts.Counter(vocabulary).text("abc") == (2, 0)


# --- personal data -----------------------------------------------------------------

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in _PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if holds(kind, m[0])
    ]


def odd_texts():
    rng = random.Random(9)
    card = "4111 1111-1111 1111"
    texts = [
        None, "", "a@b.c@d.e", "a@b.c-_x@c.d", "x@y", "1.2.3.4.5.6.7.8", "1.2.3.256", "001.02.3.000255",
        card, "1" + card, f"{card} 7", f"5--{card}", "é😀 +1 (555) 123-4567 😀 me@é.x you@ok.io",
        "+1 2", "++12345678901", "9" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" + " " * 3000,
    ]
    texts += ["".join(rng.choices("ab12.@+-_ ()5", k=120)) for _ in range(300)]
    texts += ["".join(rng.choices("0123456789 -.", k=150)) for _ in range(200)]
    return texts


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = pii.find_spans(docs, pii.fit_classifier(docs))
    got = {r["doc_id"]: r["spans"] for r in found.select("doc_id", pii.spans_text(F.col("base")).alias("spans")).collect()}
    assert got == {i: ",".join(plain_spans(t)) for i, t in enumerate(texts)}


def test_personal_data_in_long_repeated_texts_with_clashing_columns(spark):
    """Matches far into a text, and rows that repeat one another."""
    text = "plain words " * 2000 + "mail a.b@c.org " + "and " * 3000 + "host 10.0.0.7 card 4111 1111 1111 1111 "
    docs = spark.createDataFrame([(1, text, "s", 1, 2), (1, text, "s", 1, 2), (None, text, None, None, None)], DOCS + ", spans string, base int, email int")
    found = pii.find_spans(docs, pii.fit_classifier(docs)).select(pii.spans_text(F.col("base")).alias("b")).collect()
    assert [r["b"] for r in found] == [",".join(plain_spans(text))] * 3 and len(plain_spans(text)) == 3
    clean = pii.redact(docs, pii.fit_classifier(docs))
    assert clean.columns == docs.columns and clean.count() == 3
    assert clean.filter("text like '%<EMAIL>%' and text like '%<IP>%' and text like '%<CARD>%'").count() == 3


def test_beliefs_settle():
    """Another step of expectation-maximisation moves nothing."""
    rng = random.Random(2)
    cells = [{"votes": tuple(rng.choice([-1, 0, 1]) for _ in range(pii.LABELERS)), "count": rng.randrange(1, 50)} for _ in range(60)]
    settled = pii._posteriors(cells, 1e-6)
    finer = pii._posteriors(cells, 1e-10)
    assert max(abs(settled[v] - finer[v]) for v in settled) < 1e-2
    assert {round(b) for b in settled.values()} == {0, 1}


def test_personal_data_query(spark, sf_dir):
    rows = duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    found = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, sf_dir).collect()}
    for doc_id, text in rows:
        base = ",".join(plain_spans(text))
        assert found[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert found[doc_id]["spans"].startswith(base)
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text):
            if re.search("[0-9]", m[1]) and re.search("[a-f]", m[1]):
                assert f"secret:{m.start(1)}:{m.end(1)}" in found[doc_id]["spans"]


def test_voting_keeps_secrets_and_drops_lookalikes(spark):
    rng = random.Random(6)
    hexed = lambda: "".join(rng.choices("0123456789abcdef", k=38)) + "a1"
    rows = [f'login {"token" if i % 3 else "api key"} = "{hexed()}" end' for i in range(120)]
    rows += [f"see commit version2023chapterlongname{i} there" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(rows)), DOCS)
    found = pii.find_spans(docs, pii.fit_classifier(docs)).collect()
    kept = {r["doc_id"] for r in found if r["extra"]}
    assert kept == set(range(120))


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "é me@x.io, 1.2.3.4 and +1 (555) 123-4567."), (2, None), (3, "plain"), (None, "a@b.cd")]
    docs = spark.createDataFrame([(*r, "keep", 5) for r in rows], "doc_id long, text string, extra string, base int")
    clean = pii.redact(docs, pii.fit_classifier(docs))
    assert clean.columns == docs.columns
    assert [r["text"] for r in clean.collect()] == ["é <EMAIL>, <IP> and <PHONE>.", None, "plain", "<EMAIL>"]
    assert pii.redact(docs.limit(0), pii.fit_classifier(docs.limit(0))).count() == 0


def test_personal_data_runs_no_python(spark, sf_dir, plan):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES["op4_pii"](spark, sf_dir)))


# --- toxicity ----------------------------------------------------------------------


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    net = toxicity.fresh_network(np.random.default_rng(1), {"the": 1.0, "of": 0.5})
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows = [["a", "bb", "the"], ["cc", "the", "of", "xx", "yy", "zz"]]
    lexicon = toxicity._Lexicon(net, sorted({w for x in windows for w in x}))
    ids, labels = np.stack([lexicon.ids(w) for w in windows]), np.array([1.0, 0.0])
    gradients = toxicity._batch_gradients(net, lexicon, ids, labels, np.ones(2))

    def loss():
        p = toxicity._forward(net.weights, lexicon.inputs(net, ids), ids != 0)[0].astype(float)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, values in net.weights.items():
        for at in np.argwhere(np.abs(gradients[name]) > 1e-4)[:4]:
            at, before = tuple(at), values[tuple(at)]
            values[at] = before + 1e-2
            up = loss()
            values[at] = before - 1e-2
            down = loss()
            values[at] = before
            assert gradients[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-5, rel=0.05)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = toxicity.windows_of(n)
        covered = {i for s in starts.tolist() for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and (np.diff(starts) <= toxicity.STRIDE).all()


def test_planted_toxicity_is_learnt(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeioubdgkl", k=rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(600):
        text = rng.choices(vocabulary, k=rng.randrange(5, 400))
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vilenasty", "foulbad", "grimhate"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.filter("doc_id % 3 <> 1").select("doc_id", "toxic")
    network = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, network).collect()}
    held = [(scores[i] >= toxicity.THRESHOLD, t == 1) for i, _, t in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    again = toxicity.fit(docs, labels)
    assert all(np.allclose(network.weights[k], again.weights[k]) for k in network.weights)
    odd = spark.createDataFrame(
        [(None, "x y"), (1, None), (2, ""), (2, ""), (3, "w" * 50_000), (4, "a b " * 30_000)], DOCS
    )
    found = toxicity.score(odd, network).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(odd.limit(0), network).count() == 0


def test_long_runs_are_read_whole(spark):
    for n in (1, 40, 41, 60, 61, 80, 81, 999):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.pieces_of(run)
        assert all(len(p) <= toxicity.LONGEST for p in pieces)
        assert all(any(run[i : i + 20] in p for p in pieces) for i in range(n))
        row = spark.createDataFrame([(run,)], "run string").select(toxicity._pieces_of(F.col("run")))
        assert row.first()[0] == pieces


def test_every_part_of_a_text_without_spaces_counts():
    net = toxicity.fresh_network(np.random.default_rng(1), {"the": 1.0})
    reader = toxicity.Reader(net)
    run = "".join(chr(0x4E00 + i % 300) for i in range(3000))
    for text in (run, "_".join(["word"] * 500), "\u200b".join(["word"] * 500)):
        places = range(0, len(text), 97)
        planted = [f"{text[:at]}vilenasty{text[at:]}" for at in places]
        vectors = [net.word_vectors(toxicity.clean_words(x)) for x in (text, *planted)]
        assert all(v.shape != vectors[0].shape or (v != vectors[0]).any() for v in vectors[1:])
        for x in planted:
            assert any("vilenasty" in piece for piece in toxicity.clean_words(x))
    short = "word_" * 12
    planted = [f"{short[:at]}vilenasty{short[at:]}" for at in range(41, len(short), 5)]
    assert all(abs(score - reader.scores([short])[0]) > 1e-7 for score in reader.scores(planted))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    for rows in ([], [(1, 0)], [(9, 1), (None, 0), (1, None)]):
        network = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.score(docs, network).collect()] == [0.0, 0.0]


# --- formats -----------------------------------------------------------------------

HARD = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\\\|<", "<\\|", "<<||", "a\\", "\\n\n", "", "é😀<|im_end|>\n"]


def test_every_layout_gives_the_same_turns(spark):
    records = [
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, '{"other": 1}'), (8, "not json"), (9, None)]
    df = spark.createDataFrame(rows, "id long, record string")
    turns = chat_format.record_turns(df, "id", "record").orderBy("conversation", "turn").collect()
    assert [(t["conversation"], t["role"], t["text"]) for t in turns] == [
        x for i in range(5) for x in ((i, "user", "q"), (i, "assistant", "a"))
    ]
    assert [r["conversation"] for r in chat_format.unmapped_records(df, "id", "record").collect()] == [7, 8, 9]
    with pytest.raises(ValueError):
        chat_format.row_turns(df)


def test_tables_of_any_known_layout_give_the_same_turns(spark):
    """Told by the table's own schema, whatever else it holds and in whatever order."""
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (None, None, None, None)]
    want = None
    for names in chat_format.ROW_LAYOUTS.values():
        schema = ", ".join(f"{n} {kind}" for n, kind in zip(names, ("long", "int", "string", "string")))
        df = spark.createDataFrame([(*r, "x", 2.0, ["y"]) for r in said], schema + ", conversation string, loss double, tags array<string>")
        turns = chat_format.row_turns(df.select(*df.columns[::-1]))
        assert turns.columns == ["conversation", "turn", "role", "text"]
        got = sorted(map(str, turns.collect()))
        want = want or got
        assert got == want and len(got) == 3
    nested = spark.createDataFrame([(1, 1, "user", ("a",))], "conv_id long, turn int, role string, text struct<body: string>")
    assert chat_format.row_layout(nested.schema) is None
    with pytest.raises(ValueError, match="text.body"):
        chat_format.row_turns(nested)


def test_a_very_long_turn_is_formatted_whole(spark):
    long = "<|im_end|>\\ " * 50_000
    df = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(chat_format.format_turns(chat_format.row_turns(df))).first()
    assert row["turns"][0]["text"] == long == row["loss_text"]


def test_formatting_is_reversible_and_masks_assistants(spark):
    rng = random.Random(4)
    talks = {i: [(rng.choice(["user", "assistant", "a\n<|b\\n", ""]), rng.choice(HARD)) for _ in range(rng.randrange(1, 7))] for i in range(60)}
    rows = [(c, t, *said) for c, talk in talks.items() for t, said in enumerate(talk)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conversation long, turn long, role string, text string")
    formatted = chat_format.format_turns(turns)
    for row in formatted.collect():
        masked = [row["formatted"][s["start"] : s["end"]] for s in row["loss"]]
        assert len(masked) == sum(r == "assistant" for r, _ in talks[row["conversation"]])
        assert row["formatted"].count("<|im_start|>") == len(talks[row["conversation"]])
    for row in chat_format.read_back(formatted).collect():
        talk = talks[row["conversation"]]
        assert [tuple(t) for t in row["turns"]] == talk
        assert row["loss_text"] == "".join(x for r, x in talk if r == "assistant")


def test_format_edge_rows(spark, plan, sf_dir):
    rows = [(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (1, None, "user", "x")]
    schema = "conversation long, turn long, role string, text string"
    formatted = chat_format.format_turns(spark.createDataFrame(rows, schema))
    back = {r["conversation"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_back(formatted).collect()}
    assert back == {None: [("", "")], 1: [("user", "x"), ("assistant", ""), ("assistant", "")]}
    assert chat_format.format_turns(spark.createDataFrame([], schema)).count() == 0
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES["op10_chat_format"](spark, sf_dir)))


def plain_worst_window(network, words):
    """The highest score of any window of the words, one word and one window at a time, in double precision."""
    w = {name: x.astype(float) for name, x in network.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = toxicity.HIDDEN

    def inputs(word):
        slots, _ = toxicity.trigram_bags([word])
        known = w["word"][network.vocabulary.get(word, 0)]
        return np.concatenate([known, np.mean([w["trigram"][s] for s in slots], axis=0)])

    def read(xs, d):
        h, states = np.zeros(hidden), []
        for x in xs:
            given, own = x @ w[f"in_{d}"] + w[f"bias_{d}"], h @ w[f"state_{d}"]
            reset, update = (sigmoid(given[a : a + hidden] + own[a : a + hidden]) for a in (0, hidden))
            candidate = np.tanh(given[2 * hidden :] + reset * own[2 * hidden :])
            h = (1 - update) * candidate + update * h
            states.append(h)
        return states

    scores = []
    size = toxicity.WINDOW
    starts = [0] if len(words) <= size else [*range(0, len(words) - size, toxicity.STRIDE), len(words) - size]
    for start in starts:
        xs = [inputs(word) for word in words[start : start + size]]
        pooled = np.zeros(2 * hidden)
        if xs:
            states = [np.concatenate(p) for p in zip(read(xs, "f"), read(xs[::-1], "b")[::-1])]
            energy = np.array([np.tanh(s @ w["attend"]) @ w["query"] for s in states])
            share = np.exp(energy - energy.max())
            pooled = sum(a * s for a, s in zip(share / share.sum(), states))
        scores.append(sigmoid(pooled @ w["out"] + w["shift"][0]))
    return max(scores)


def test_scores_are_those_of_a_plain_forward_pass_over_all_windows(spark, sf_dir):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    network = toxicity.fresh_network(rng, {word: float(rng.normal()) for word in words[:30]})
    for name, x in network.weights.items():
        network.weights[name] = (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32)
    network.slope, network.shift = 0.8, -0.4
    texts = [None, "", "...", "w1", *[" ".join(rng.choice(words + ["unseen", "x" * 130], n)) for n in (5, 63, 64, 65, 96, 97, 300)]]
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)], DOCS + ", score double, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, network).collect()}
    for i, text in enumerate(texts):
        worst = plain_worst_window(network, toxicity.clean_words(text))
        assert found[i] == pytest.approx(float(network.probability(np.array([worst]))[0]), abs=1e-4)
    assert len({round(x, 3) for x in found.values()}) > 5
