"""Operators on models and sets: chat, pieces, near duplicates, language and pages against brute force."""

import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockloom.llm import chat, dom, html_extract, jaccard_join, language, pieces
from stockloom.llm.dom import match, parse

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, sig string, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y") for i, t, lang in rows], SCHEMA)


def near_rows():
    rng = random.Random(3)
    rows, n = [], 0
    for group in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range((2, 3, 90, 1, 5, 8)[group]):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
            rows.append((n, " ".join(words), "en"))
            n += 1
    rows += [(500, None, "en"), (501, "", "en"), (502, " \n", "en"), (503, "too short", "en"), (504, "too  short", "en"), (505, "a b c d e", "en")]
    rows += [(600, "long " + " ".join(f"x{k}" for k in range(30_000)), "en"), (601, "long " + " ".join(f"x{k}" for k in range(30_001)), "en")]
    return rows


@pytest.mark.parametrize("small", [64, 4])
def test_near_classes_equal_all_pairs(spark, monkeypatch, small):
    rows = near_rows()
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2048 if small == 64 else 16)
    got = {r.doc_id: r for r in jaccard_join.near_classes(docs(spark, rows), small=small).collect()}
    shingles = {}
    for i, text, _ in rows:
        w = (text or "").split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = defaultdict(set), {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in product(shingles, shingles):
        union = len(shingles[a] | shingles[b])
        if a < b and union and len(shingles[a] & shingles[b]) >= 0.8 * union - 1e-9:
            links[a].add(b), links[b].add(a)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: (r.class_id, r.links) for i, r in got.items()} == {i: (find(i), len(links[i])) for i in shingles}


def test_near_classes_awkward(spark):
    same = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "a b c d e f", "en"), (None, "a b c d e f", "en")]
    got = jaccard_join.near_classes(docs(spark, same)).collect()
    assert sorted((str(r.doc_id), r.class_id, r.links) for r in got) == [("1", 1, 1), ("2", 1, 1), ("None", None, 0)]
    assert jaccard_join.near_classes(docs(spark, same).limit(0)).count() == 0
    assert jaccard_join.one_of_each(docs(spark, same)).columns == docs(spark, same).columns


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.999, 0.8, 4) > jaccard_join.runs_for(0.9, 0.8, 4) >= 2


VOCABULARY = pieces.Vocabulary(
    tuple((p, s, i) for i, (p, s) in enumerate([("▁", -3.0), ("▁a", -2.0), ("a", -2.5), ("b", -2.5), ("ab", -3.0), ("ba", -4.5), ("▁ab", -3.5), ("aba", -5.0), ("▁▁", -2.2), ("bab", -5.5)])),
    tuple(range(10, 266)),
)


def brute_best(codec, text):
    score = {p: s for p, s, _ in VOCABULARY.pieces}
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            piece = text[begin:end]
            s = score.get(piece, codec.unknown if end - begin == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[begin] + s)
    return best[-1]


def test_pieces_are_the_best_path_and_round_trip():
    codec, rng = pieces.Codec(VOCABULARY), random.Random(5)
    score = {i: s for _, s, i in VOCABULARY.pieces}
    for _ in range(300):
        text = "".join(rng.choice("ab  \né▁") for _ in range(rng.randrange(1, 30)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        plain = text.replace("▁", "a").replace("é", "b").replace("\n", "a")
        marked = (" " + plain).replace(" ", "▁")
        assert sum(score[i] for i in codec.encode(plain).tolist()) == pytest.approx(brute_best(codec, marked))


def word_by_word(codec, text):
    """Ids of a text, each word by a pass of its own."""
    ids = []
    for k, part in enumerate((" " + text).split(pieces.MARK) if text else []):
        marked = part.replace(" ", pieces.MARK)
        words = re.findall("▁*[^▁]+|▁+", marked) if codec.by_word else [marked]
        ids += (codec.mark if k else []) + [i for w in words for i in codec.best_path(w)]
    return ids


@pytest.mark.parametrize("extra", [(), (("b▁a", -2.9, 266),)])  # with the second, words are not apart
def test_distinct_short_words_are_encoded_together(extra, monkeypatch):
    codec, rng = pieces.Codec(pieces.Vocabulary(VOCABULARY.pieces + extra, VOCABULARY.bytes_)), random.Random(6)
    monkeypatch.setattr(pieces, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(pieces, "BYTES_AT_ONCE", 900)
    texts = [None, "", " ", "▁", "ab" * 400, "   ", ""] + ["".join(rng.choice("aaabb   \né▁日🙂\0") for _ in range(rng.randrange(60))) for _ in range(300)] + [None]
    expected = [word_by_word(codec, t) for t in texts]
    lists = list(codec.encode_all(pa.array(["x", *texts], pa.string()).slice(1)))
    assert len(lists) > 5 and [i for some in lists for i in some.to_pylist()] == expected
    assert [codec.encode(t).tolist() for t in texts] == expected
    assert [b.decode()[1:] for some in lists for b in codec.decode_all(some).to_pylist()] == [t or "" for t in texts]
    assert [n for some in lists for n in codec.count_bytes(some).tolist()] == [sum(10 <= i < 266 for i in e) for e in expected]


def test_best_path_is_left_to_long_words(monkeypatch):
    codec, seen = pieces.Codec(VOCABULARY), []
    one = codec.best_path
    words = ["".join(w) for w in product("abé", repeat=6)]
    expected = [i for w in words for i in one("▁" + w)]
    monkeypatch.setattr(pieces.Codec, "best_path", lambda self, text: seen.append(text) or one(text))
    assert codec.encode(" ".join(words)).tolist() == expected and not seen
    assert codec.encode("ab " + "a" * 50).tolist() == one("▁ab") + one("▁" + "a" * 50) and len(seen) == 1


def test_pieces_on_documents(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    if not os.path.exists(path):
        pytest.skip("no tokenizer here")
    vocabulary = pieces.load_vocabulary(path)
    rows = [(1, None, "en"), (2, "", "en"), (3, " lead  and trail ", "en"), (4, "日本語 ▁ \t\r\n 🙂", "en"), (5, "xy" * 50_000, "en"), (5, "xy", "en")]
    got = pieces.encoded(docs(spark, rows), vocabulary)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got.collect())
    back = pieces.decoded(got.filter("doc_id < 5"), vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t, _ in rows if i < 5}
    assert pieces.encoded(docs(spark, rows).limit(0), vocabulary).count() == 0


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = [r for r in language.identified(table).collect() if r.held_out and truth[r.doc_id]]
    assert got and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_language_awkward(spark):
    rows = [(i, "the and of that word is here", "en") for i in range(8)] + [(20 + i, "der und das ist nicht für sie", "de") for i in range(8)]
    rows += [(40, None, "en"), (41, "", "de"), (42, "12 345 !?", None), (None, "the word of that", None), (43, "der und das " * 50_000, None)]
    got = {r.doc_id: r for r in language.identified(docs(spark, rows)).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[43].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identified(docs(spark, rows).limit(0)).count() == 0
    unlabelled = docs(spark, [(1, "word", None)])
    assert language.identified(unlabelled).first().lang_pred == "und"


def page(nav, body, tail="Footer of all"):
    return f'<html><head><title>t</title></head><body><nav><a>{nav}</a></nav><div class="ad">Buy {nav}</div><div class="content">{body}</div><div id="comments"><p>{nav} says hi</p></div><footer>{tail}</footer></body></html>'


def test_pages_of_a_host(spark):
    bodies = [f"<h1>Title {k}</h1><p>First &amp; best {k}<br>line<p>Second  {k}\n text <script>x('</p>')</script><form>Sign up</form>" for k in range(5)]
    rows = [(k, f"https://www.site.example/{k}", page(f"nav {k}", b)) for k, b in enumerate(bodies)]
    rows += [(10, None, None), (11, "http://x.example/", ""), (12, "http://y.example/", "<p>Only<p>text"), (13, "nonsense", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k].text == f"Title {k}\n\nFirst & best {k} line\n\nSecond {k} text"
        assert got[k].wrapper == got[0].wrapper is not None and got[k].n_chars == len(got[k].text)
    assert [got[k].text for k in (10, 11, 12, 13)] == ["", "", "Only\n\ntext", "deep"]


def test_constant_texts_of_a_host_are_template(spark):
    notice = "<p>This site keeps a notice on every page.</p>"
    body = lambda k: f"<article><header><h1>Story {k}</h1></header>{notice}<h2>Summary</h2><p>Text {k} of the <b>day</b> and all that came of it in the end</p><p class='share-price'>Price {k}</p></article>"
    rows = [(k, f"https://a.example/{k}", f"<html><body class='page with-sidebar'><div class='page with-sidebar'>{body(k)}</div><footer>f</footer></body></html>") for k in range(8)]
    rows += [(100 + k, f"https://b.example/{k}", f"<body><article><p>Only two pages {k}</p>{notice}</article>") for k in range(2)]
    copies = "<body><article><p>One text that all pages share.</p><p>And another.</p></article><i>{}</i>"
    rows += [(200 + k, f"https://c.example/{k}", copies.format(k)) for k in range(9)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"Story {k}\n\nSummary\n\nText {k} of the day and all that came of it in the end\n\nPrice {k}"
    assert got[100].endswith("This site keeps a notice on every page.")  # too few pages to tell
    assert got[203].startswith("One text that all pages share.\n\nAnd another.")  # copies of a page are no template


def test_names_of_boxes():
    dropped = lambda name: parse(f'<div class="{name}">x</div>').children[0].dropped
    assert all(map(dropped, ("ad", "ad-box", "site-footer", "cookie-consent", "sidebarLeft", "x menu")))
    assert not any(map(dropped, ("shadow", "share-price", "with-sidebar", "no-ads-here", "content", "page")))


def test_deep_and_wide_pages(spark):
    deep = lambda k: "<div>" * 1500 + f"<p>text {k}</p>"
    wide = lambda k: "<ul>" + "".join(f"<li><b>{k}</b> {i * k}</li>" for i in range(2000)) + "</ul>"
    rows = [(k, "http://d.example/x", deep(k)) for k in range(3)] + [(10 + k, "http://w.example/x", f"<body><article>{wide(k)}</article>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "text 1" and got[12].count("\n\n") == 1999
    began = time.perf_counter()
    assert len(match(parse(wide(1)), parse(wide(2)))) == 2 * 2000 + 2
    assert len(match(parse(deep(1)), parse(deep(2)))) == 1502
    assert time.perf_counter() - began < 3


def test_tree_matching_is_largest():
    a, b = parse("<ul><li>1<li>2<b>x</b><li>3</ul>"), parse("<ul><li>1<p>n</p><li>2<b>y</b></ul>")
    labels = sorted(x.label for x, _ in match(a, b))
    assert labels == ["#root", "b", "li", "li", "ul"]


def test_matching_of_long_lists_is_largest_too(monkeypatch):
    # 701 entries against the same without the first: over 250,000 pairs.
    entries = [f"<{'li' if i % 3 else 'p'}>{'<b>x</b>' * (i % 4)}</{'li' if i % 3 else 'p'}>" for i in range(700)]
    a, b = parse("<p><b>y</b></p>" + "".join(entries)), parse("".join(entries))
    found = match(a, b)
    assert len(found) == 1 + sum(1 + i % 4 for i in range(700))
    rng = random.Random(5)
    page = lambda: "".join(f"<{t}>{'<b></b>' * rng.randrange(3)}</{t}>" for t in rng.choices(["li", "p", "h1"], k=90))
    for _ in range(5):
        first, second, results = page(), page(), []
        for cells in (dom.CELLS, 0):
            monkeypatch.setattr(dom, "CELLS", cells)
            x, y = parse(first), parse(second)
            places = {id(n): k for k, n in enumerate([*x.children, *y.children])}
            results.append([(places[id(p)], places[id(q)]) for p, q in match(x, y) if id(p) in places])
        assert results[0] == results[1]
        monkeypatch.undo()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    n = len(chat.STATES)
    model = chat.Model(np.log(rng.random(n)), np.log(rng.random((n, n))), {})
    scores = np.log(rng.random((4, n)))
    value = lambda p: model.start[p[0]] + scores[0][p[0]] + sum(model.move[a, b] + scores[t + 1][b] for t, (a, b) in enumerate(zip(p, p[1:])))
    best = max(product(range(n), repeat=4), key=value)
    assert tuple(chat.viterbi(model, scores)) == best


def conversations(spark, n, turns):
    rows = []
    for c in range(n):
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "Why is it so?" if role == "user" else "Because of that.\nAnd more of it, a longer line that goes on." if role == "assistant" else "Be kind."))
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_roles_are_recovered(spark):
    got = chat.parse_conversations(conversations(spark, 40, 6)).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.n_right for r in held) >= 0.9 * sum(r.n_lines for r in held)
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}<|end|>\n" for r in got)


def test_blocks_give_the_same_turns(spark, monkeypatch):
    table = conversations(spark, 6, 9)
    whole = sorted(map(str, chat.parse_conversations(table).collect()))
    lines = chat.lines_of(chat.with_markers(chat.as_turns(table)))
    model = chat.fit(lines)
    one = {(r.conv, r.line): (r.state, r.opened) for r in chat.recovered(lines, model).collect()}
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    cut = chat.lines_of(chat.with_markers(chat.as_turns(table)))
    assert {(r.conv, r.line): (r.state, r.opened) for r in chat.recovered(cut, model).collect()} == one and whole


def test_conversations_awkward(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (None, None, "tool", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "assistant", "A: long\n" * 3000)]
    rows += [(-1, 0, "user", "of minus one"), (None, 1, "user", "of nobody"), (2, None, "user", "last"), (2, 1, "user", "between")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("block", F.lit("x")).withColumn("line", F.lit(1))
    turns = chat.as_turns(table).orderBy("conv", "turn").collect()
    assert [(r.turn, r.text) for r in turns if r.conv == "=2"] == [(1, "same"), (2, "same"), (3, "between"), (4, "last")]
    assert [r.text for r in turns if r.conv == "~"] == ["of nobody", "x"] and [r.text for r in turns if r.conv == "=-1"] == ["of minus one"]
    got = chat.parse_conversations(table).collect()
    lines = Counter(r.conv for r in chat.lines_of(chat.with_markers(chat.as_turns(table))).collect())
    assert lines["=3"] >= 3001 and lines["=2"] >= 4 and lines["~"] >= 2
    assert Counter({k: sum(r.n_lines for r in got if f"={r.conv_id}" == k or (r.conv_id is None and k == "~")) for k in lines}) == lines  # none is lost
    assert [r.held_out for r in got if r.conv_id is None] == [False] * sum(r.conv_id is None for r in got)
    assert sorted(map(str, chat.parse_conversations(table.repartition(5)).collect())) == sorted(map(str, got))
    text_ids = table.withColumn("conv_id", F.col("conv_id").cast("string"))
    assert {r.conv_id for r in chat.parse_conversations(text_ids).collect()} == {"1", "2", "3", "-1", None}
    assert chat.parse_conversations(table.limit(0)).count() == 0


def test_language_ties_and_clashing_names(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_language", F.lit("mine")).withColumn("found_language", F.lit(7))
    kept = language.with_language(table)
    assert kept.columns == table.columns
    assert {(r._language, r.found_language) for r in kept.collect()} == {("mine", 7)}
    model = language.fit(np.eye(language.DIMENSIONS, dtype=np.float32)[[0, 0, 1]], np.array(["aa", "bb", "cc"], dtype=object))
    assert model.predict(None) == (language.UNKNOWN, 0.0) and model.predict("12 34") == (language.UNKNOWN, 0.0)
    assert model.predict("abc")[0] == model.predict("abc")[0] in ("aa", "bb", "cc")


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    docs_now = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs_now = docs_now, stage(spark, docs_now, SF)
        assert docs_now.columns == table.columns, name
    kept = [r.doc_id for r in docs_now.collect()]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]) for i in kept]
    assert len(set(kept)) == len(kept) and len(set(norm)) == len(norm)
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} <= set(kept) and all(r.round_trip for r in last)
