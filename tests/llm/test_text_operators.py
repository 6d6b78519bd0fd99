"""Extraction, tokens, codec, URL rules, quality and personal data: edge cases and brute-force twins."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import html_extract, packing, pii, quality, sentencepiece_codec, token_count, url_filter

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Null, empty, blank, odd and long texts, special strings, and a repeated row. The table's extra columns clash.
TEXTS = [
    None, "", " \n\t ", "Hello WORLD's end.", "<|endoftext|> <|endoftext", "a\x1cb\x85c z", "ÉTÉ Straße İ ΑΣ ﬁ",
    "日本語 テスト 🎉", "don't I'LL 12.5", "x" * 3000, "the end of it all " * 900, "the end of it all " * 900,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, 8, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, doc_tokens int, kept string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts_equal_the_library(docs, empty):
    tok = Tokenizer.from_file(WORD_BPE)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    rows = token_count.count_tokens(docs, WORD_BPE).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((TEXTS[r.doc_id] or "").encode()), want[r.doc_id] > 2048)
    assert token_count.count_tokens(empty, WORD_BPE).collect() == []


def test_ids_and_counts_of_every_ascii_character():
    """Alone, in pairs, and in random strings, against the library's own ids."""
    tok = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(12)
    ascii_ = [chr(i) for i in range(128)]
    pool = [*ascii_, *"éßñüœ\u3000漢字😀İıſ\x85", "<|endoftext|>", "'s"]
    cases = [*ascii_, *("a" + c + "b" for c in ascii_), *(a + b for a in ascii_ for b in ascii_)]
    cases += ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(5000)]
    words, counts = packing.word_ids(WORD_BPE), token_count.counter(WORD_BPE)
    for t, made in zip(cases, tok.encode_batch(cases, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.ids(t), "<u4").tolist() == made.ids, t
        assert counts.count(t) == len(made.ids), t
    with pytest.raises(ValueError):
        words.of_piece[" "]


def test_merge_count_follows_ranks():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("ab", "c"): 3}
    assert token_count.merge_count(list("abc"), ranks) == 1
    assert token_count.merge_count(list("abab"), ranks) == 2
    assert token_count.merge_count(["z"], ranks) == 1


def brute_bpe(symbols, ranks):
    while True:
        found = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks), default=None)
        if found is None:
            return len(symbols)
        i = found[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_merge_count_against_rescans():
    rng = random.Random(4)
    for _ in range(200):
        ranks, parts = {}, list("abc")
        while len(ranks) < 12:
            p = (rng.choice(parts), rng.choice(parts))
            if p not in ranks:
                ranks[p] = len(ranks)
                parts.append("".join(p))
        word = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        assert token_count.merge_count(word, ranks) == brute_bpe(word, ranks)


def test_packing_covers_every_id_once(docs, empty):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(docs, WORD_BPE).collect()
    ids = {i: np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in enumerate(TEXTS)}
    held: dict = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[3])
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 4096
    assert packing.pack(empty, WORD_BPE).collect() == []


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(0)
    for _ in range(5):
        demand = rng.integers(0, 40, 32)
        patterns, counts = packing.integer_patterns(demand)
        sizes = np.arange(1, 33)
        assert (counts @ patterns == demand).all() and (patterns @ sizes <= 32).all()
        _, x = packing.solve_patterns(demand)  # its sum is the least that any patterns can do
        assert (demand * sizes).sum() / 32 - 1e-6 <= x.sum() and counts.sum() <= np.ceil(x.sum() - 1e-6) + 3
    assert packing.integer_patterns(np.zeros(32, dtype=np.int64))[1].sum() == 0


def test_knapsack_is_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices = rng.random(6).round(2)
        value, taken = packing.knapsack(prices, 9)
        best = [0.0] * 10
        for c in range(1, 10):
            best[c] = max([best[c - 1], *(best[c - s - 1] + p for s, p in enumerate(prices) if s < c)])
        assert abs(value - best[9]) < 1e-9 and abs(taken @ prices - value) < 1e-9 and taken @ np.arange(1, 7) <= 9


def test_codec_equals_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = {r.doc_id: r.ids for r in sentencepiece_codec.encode(docs, PIECE_BPE).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(TEXTS)}
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECE_BPE), PIECE_BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: sp.decode(sp.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert all(r.restored for r in sentencepiece_codec.round_trip(docs, PIECE_BPE).collect())
    assert sentencepiece_codec.round_trip(empty, PIECE_BPE).collect() == []
    c, rng = sentencepiece_codec.codec(PIECE_BPE), random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("abcdeéñ▁ \n\t  the.,!123日🎉<s>") for _ in range(rng.randint(0, 60)))
        assert c.encode(s) == sp.encode(s), s


def test_stretches_go_through_the_stream():
    """Every id comes from the streaming search, whose window stays bounded; ids are committed where paths meet."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    c = sentencepiece_codec.Codec(PIECE_BPE)
    texts = ["short words only here", "Donaudampfschifffahrtsgesellschaft internationalizationalism", "ab" * 5000]
    assert [c.encode(t) for t in texts] == [sp.encode(t) for t in texts]
    assert c.marked.searches >= 7 and c.marked.commits > 100
    e = sentencepiece_codec.StreamingEncoder(c.pieces)
    for ch in "▁" + "internationalizationof" * 2000:  # one character at a time
        e.feed(ch)
        assert len(e.last) <= 3 * c.pieces.longest
    before = len(e.out)
    assert before > 2000 and e.finish() == sp.encode("internationalizationof" * 2000)


def test_streaming_window_is_bounded_and_unigram_is_best():
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -1.9, "aba": -3.3, "bb": -3.0}
    p = sentencepiece_codec.Pieces(scores, {k: i for i, k in enumerate(scores)}, [], 9, True)
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        e = sentencepiece_codec.StreamingEncoder(p)
        e.feed(text)
        best = [0.0]
        for i in range(1, len(text) + 1):
            best.append(max(best[i - n] + scores[text[i - n : i]] for n in (1, 2, 3) if n <= i and text[i - n : i] in scores))
        names = list(scores)
        made = [names[i] for i in e.finish()]
        assert "".join(made) == text and abs(sum(scores[x] for x in made) - best[-1]) < 1e-9
        assert e.widest <= 4 * p.longest + 1
    e = sentencepiece_codec.StreamingEncoder(p)
    e.feed("abc")
    assert e.finish() == [2, 9]


def test_main_text():
    f = html_extract.main_text
    assert f(None) == f("") == f("<p>") == f("<script>x</script>") == ""
    page = (
        "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>We use cookies on this site.</div>"
        "<article><header><h1>Title &amp; more</h1><span>by line</span></header><p>One <b>two</b>\n three<br>four<p>Five"
        "<form><input>Send</form><div class=ad>Buy</div><ul><li>a<li>b</ul><section id=comments><p>I say</p></section></article>"
        "<aside>side</aside><footer>foot</footer>"
    )
    assert f(page) == "Title & more\n\nOne two three four\n\nFive\n\na\n\nb"
    bare = "<div class=menu>m m m</div><div><h2>Head</h2><div><p>Some text of the page.</p><p>And some more of it.</p></div></div>"
    assert f(bare) == "Head\n\nSome text of the page.\n\nAnd some more of it."
    assert f("<header><h1>Site</h1></header><div><p>The text of a page.</p><p>And its end.</p></div>") == "The text of a page.\n\nAnd its end."
    assert f("<div>" * 20000 + "deep") == "deep" and f("<" * 2000 + " a").endswith("< a")
    assert f("<p>x</p>" * 3000) == "\n\n".join("x" * 3000)


def test_main_text_beside_the_core():
    """Pages without article or main: bare text and inline elements beside the core."""
    f, long = html_extract.main_text, "a long line of the page's own text " * 6
    made, core = " ".join(long.split()), "<div><p>First paragraph of it.</p><p>And the second one.</p></div>"
    want = f"Top\n\n{made} {made}\n\nFirst paragraph of it.\n\nAnd the second one.\n\n{made}"
    assert f(f"<body><h1>Top</h1>{long}<br>{long}{core}{long}</body>") == want
    assert f(f"<body><div class=wrap><h1>Top</h1>{long}<b>{long}</b>{core}<span>{long}</span></div></body>") == want
    links = "".join(f"<a href=x{i}>to {i}</a> " for i in range(9))
    assert f(f"<body>{links}<h1>Top</h1>{long}<br>{long}{core}{long}</body>") == want


def recursive_density(node):
    """(characters, tags, link characters, link tags) of a tree by the definition, and every node's own."""
    found = {}

    def walk(x):
        c = t = lc = lt = 0
        for i in x.items:
            if isinstance(i, str):
                c += len(re.sub(r"\s", "", i))
            elif not i.noise:
                a = walk(i)
                c, t, lc, lt = c + a[0], t + 1 + a[1], lc + a[2], lt + a[3]
        if x.tag == "a":
            lc, lt = c, lt + 1
        found[id(x)] = (c, t, lc, lt)
        return found[id(x)]

    walk(node)
    return found


def test_density_against_the_definition():
    rng = random.Random(5)
    for _ in range(30):
        part = lambda: "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<a href=x>link</a>", "<b>", "</b>", "some words ", "x", "<br>", "<ul><li>", "<nav>n</nav>"]) for _ in range(40))  # noqa: E731, E501
        root = html_extract.parse(part())
        nodes = html_extract.in_order(root)
        html_extract.mark_noise(nodes)
        ratio = html_extract.measure(nodes)
        want = recursive_density(root)
        for x in nodes:
            if x.noise or not x.chars:
                continue
            c, t, lc, lt = want[id(x)]
            assert (x.chars, x.tags, x.links, x.link_tags) == (c, t, lc, lt)
            t, lc1, lt1 = max(1, t), max(1, lc), max(1, lt)
            scale = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            assert x.density == pytest.approx(c / t * max(0.0, math.log(max(1.0, c / lc1 * t / lt1)) / math.log(scale)), rel=1e-9) if math.log(scale) > 0 else True
            kids = [i for i in x.items if isinstance(i, html_extract.Node) and not i.noise and i.chars]
            assert x.score == pytest.approx(sum(k.density for k in kids))


def test_density_chooses_without_telling_names():
    """No article, main, class or role: the densest subtree and the body path's threshold choose."""
    f, long = html_extract.main_text, "a long paragraph of the page's own text, which goes on for a while " * 4
    links = "".join(f"<a href=/{i}>page {i}</a> " for i in range(12))
    page = f"<body><div>{links}</div><div><div><h2>Head</h2><p>{long}</p><p>Yes.</p><p>{long}<a href=z>a link</a></p><p>End.</p></div><div>{links}</div></div><div>{links}</div></body>"
    assert f(page) == "\n\n".join(["Head", long.strip(), "Yes.", long + "a link", "End."])
    # Which of two blocks is the text is a matter of density alone.
    words = "<p>" + "words of some text in one block " * 8 + "</p>"
    assert "words" in f(f"<body><div>{words * 3}</div><div>{links}</div></body>") and "page 3" not in f(f"<body><div>{words * 3}</div><div>{links}</div></body>")
    # The article element is evidence, not the answer: an empty one beside the text does not hide it.
    assert f(f"<body><article><a href=x>read</a></article><div>{words * 3}</div></body>").count("one block") == 24


def test_main_text_in_a_form():
    f = html_extract.main_text
    inner = "<input><label>Find</label><button>Go</button><article><h1>Head</h1><p>Text of the page.</p><form><input>Send</form></article>"
    for form in ("<form>", "<form role=form><fieldset>"):
        assert f(f"<body>{form}{inner}</body>") == "Head\n\nText of the page."
    assert f("<form><h1>Head</h1><div><p>One text.</p><p>Two texts.</p></div><select><option>a</select></form>") == "Head\n\nOne text.\n\nTwo texts."
    page = "<article><p>Text.</p><div class='{}'><p>More.</p></div></article>".format
    assert all(f(page(c)) == "Text.\n\nMore." for c in ("commentary", "match-commentary", "commentator"))
    assert all(f(page(c)) == "Text." for c in ("comment", "comments", "commentsArea", "commentlist", "commentsection", "comment-form", "commenter"))
    assert f("<article class=commentary><p>Text.</p></article>") == "Text."


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (1, None, "<p>a</p>", 3), (1, None, "<p>a</p>", 3)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert html_extract.extract_main_text(pages.where("false")).collect() == []


def test_url_rules(spark):
    urls = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
        ("http://WWW.Example.com/en/7x?q", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("x://a.com/en/", "a.com", "/en/", "com/en/", "block"), ("x://notcom/en/", "notcom", "/en/", None, "allow"),
        ("x://example.net/de/81#t", "example.net", "/de/81", "example.net/de/8", "block"),
        ("x://b.net/de/1", "b.net", "/de/1", "net/de/", "allow"), ("x://c.org/es/", "c.org", "/es/", "org/es/", "block"),
        ("http://m.ads-track.x.fr/a", "m.ads-track.x.fr", "/a", None, "block"),
        ("http://m.ads-track.x.fr/privacy", "m.ads-track.x.fr", "/privacy", None, "allow"),
        ("http://x.fr/ads-track", "x.fr", "/ads-track", None, "allow"), ("http://x.fr/a?AD_SLOT=1", "x.fr", "/a", None, "block"),
    ]
    df = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.where("false")).collect() == []


def test_url_index_misses_no_rule(spark):
    rng = random.Random(3)
    words = ["ads", "banner", "x1", "img", "click", "track"]
    rules = tuple({f"{rng.choice(['', '||', '|http', '/'])}{rng.choice(words)}{rng.choice(['^', '*', '-', '/', ''])}{rng.choice(words)}{rng.choice(['', '^', '|'])}" for _ in range(60)})
    urls = ["http://" + "".join(rng.choice(words) + rng.choice("./-?=&") for _ in range(5)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, pattern_rules=rules, path_rules=()).collect()}
    parsed = [re.compile(url_filter.parse_rule(r).pattern) for r in rules]
    assert got == {i: "block" if any(p.search(u) for p in parsed) else "allow" for i, u in enumerate(urls)}


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_rows(docs, empty):
    for t in [*TEXTS[:10], "a b c a b c d\n\na b c\n a b\na b c", "x\x85y  \x0b z # *"]:
        m = quality.measures(t)
        assert tuple(m[c] for c in quality.COUNTS) == brute_counts(t)
    rows = quality.judge_quality(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.base_failed and not r.kept for r in rows if r.doc_id < 9)
    assert quality.judge_quality(empty).collect() == []
    assert quality.keep_good(empty).columns == empty.columns and quality.keep_good(empty).count() == 0


def drawn_votes(n, seed=0):
    """Patterns of six rules, two of which abstain at times, and whether each document is bad."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.15
        votes = "".join("b" if rng.random() < (0.6 if bad else 0.02) else "g" for _ in range(6))
        out.append(("".join("-" if i > 3 and rng.random() < 0.4 else c for i, c in enumerate(votes)), bad))
    return out


def test_em_finds_the_bad_ones():
    drawn = drawn_votes(4000)
    patterns = dict(collections.Counter(v for v, _ in drawn))
    model = quality.fit_votes(patterns, 6)
    assert sum((model.posterior(v) < 0.5) == bad for v, bad in drawn) / 4000 > 0.97 and abs(model.prior - 0.85) < 0.05
    assert np.allclose(model.on_good, 0.02, atol=0.02) and np.allclose(model.on_bad, 0.6, atol=0.1)
    # One bad vote is outweighed, and what is kept does not hang on the start.
    assert model.posterior("bggggg") > 0.5 > model.posterior("bbbggg")
    for start in quality.STARTS:
        other = quality.fit_votes(patterns, 6, starts=(start,))
        assert all((other.posterior(v) < 0.5) == (model.posterior(v) < 0.5) for v in patterns)
    assert quality.fit_votes({}, 5).posterior("-----") == pytest.approx(0.85)


def test_em_against_a_plain_loop_over_documents():
    drawn = [v for v, _ in drawn_votes(300, seed=2)]
    prior, wrong, right = 0.7, [0.05] * 6, [0.5] * 6
    for _ in range(40):
        p = []
        for v in drawn:
            good, bad = prior, 1 - prior
            for c, w, r in zip(v, wrong, right, strict=True):
                good *= {"b": w, "g": 1 - w}.get(c, 1)
                bad *= {"b": r, "g": 1 - r}.get(c, 1)
            p.append(good / (good + bad))
        prior = (sum(p) + 1) / (len(p) + 2)
        for i in range(6):
            cast = [(v[i], x) for v, x in zip(drawn, p, strict=True) if v[i] != "-"]
            wrong[i] = (sum(x for c, x in cast if c == "b") + 1) / (sum(x for _, x in cast) + 21)
            right[i] = max(wrong[i], (sum(1 - x for c, x in cast if c == "b") + 4) / (sum(1 - x for _, x in cast) + 8))
    model = quality.fit_votes(dict(collections.Counter(drawn)), 6, rounds=40, starts=((0.7, 0.05, 0.5),))
    assert model.prior == pytest.approx(prior, abs=1e-6) and np.allclose(model.on_good, wrong) and np.allclose(model.on_bad, right)
    assert model.posterior(drawn[0]) == pytest.approx(
        prior * np.prod([{"b": w, "g": 1 - w}.get(c, 1) for c, w in zip(drawn[0], wrong, strict=True)])
        / (prior * np.prod([{"b": w, "g": 1 - w}.get(c, 1) for c, w in zip(drawn[0], wrong, strict=True)])
           + (1 - prior) * np.prod([{"b": r, "g": 1 - r}.get(c, 1) for c, r in zip(drawn[0], right, strict=True)])), abs=1e-6)


def test_posterior_decides_on_documents(spark):
    """Documents with a bad vote stay where the others outweigh it, and the filter keeps what the query keeps."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge_quality(docs).where("not base_failed").collect()
    cast = [r for r in rows if "b" in r.votes]
    assert {r.kept for r in cast} == {True, False} and all(r.kept for r in rows if "b" not in r.votes)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    clash = docs.withColumn("_votes", F.lit("x")).withColumn("kept", F.lit(1))
    assert quality.keep_good(clash).columns == clash.columns and quality.keep_good(clash).count() == len(kept)


def test_quality_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.judge_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    both = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    good, bad = both.where("quality = 1"), both.where("quality = 0")
    assert good.where("kept").count() / good.count() > 0.98 and bad.where("kept").count() / bad.count() < 0.05


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_patterns():
    rng = random.Random(6)
    texts = ["a@b@c.com x@y..z", "1.2.3.4.5.6.7.8 999.1.1.1 01.2.3.4", "4111 1111-1111 1111 +1 (222) 333-4444", "٣+1(2)3 555-1234567", "@" * 40]
    texts += ["".join(rng.choice("0123456789 .-+()@ab") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


@pytest.fixture(scope="module")
def tagger():
    return pii.train(*pii.labelled_windows(["plain words of some text that goes on for quite a while"]))


def test_tagger_learns_held_out_spans(tagger):
    """Of spans that it was not trained on, in text it has not seen: recall and precision."""
    ids, tags = pii.labelled_windows(["other words in a text that nobody has seen in training"], 400, seed=99)
    em = tagger.emissions(tagger.states(ids))
    hit = got_n = want_n = 0
    for j in range(len(ids)):
        whole = lambda path: {s for s in pii.tag_spans(path, 0) if s[2] < pii.LESSON}
        got, want = whole(tagger.decode(em[:, j])), whole(tags[j].tolist())
        hit, got_n, want_n = hit + len(got & want), got_n + len(got), want_n + len(want)
    assert hit / want_n > 0.85 and hit / got_n > 0.85


def test_gradients():
    m = pii.Tagger.fresh(np.random.default_rng(0), 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, tags = pii.labelled_windows(["words"], 4)
    _, g = m.loss(ids, tags)
    for k in ("X", "R", "V", "v", "T", "S"):
        at = tuple(int(x) for x in np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old = m.p[k][at]
        ends = []
        for step in (1e-3, -1e-3):
            m.p[k][at] = old + step
            ends.append(m.loss(ids, tags)[0])
        m.p[k][at] = old
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[k][at], rel=1e-2), k


def test_decoding_against_all_paths():
    """The best of all tag paths by trying each, for a text of four characters."""
    rng = np.random.default_rng(4)
    m = pii.Tagger.fresh(rng)
    for k in ("T", "S"):
        m.p[k] = rng.normal(0, 2, m.p[k].shape).astype(np.float32)
    few = (0, 1, 2, 3)
    for _ in range(20):
        em = np.full((4, len(pii.TAGS)), -100.0)
        em[:, few] = rng.normal(0, 2, (4, 4))

        def score(path, em=em):
            steps = sum(m.p["T"][a, b] + pii.LEGAL[a, b] for a, b in zip(path, path[1:], strict=False))
            return m.p["S"][path[0]] + pii.LEGAL[0, path[0]] + steps + sum(em[t, x] for t, x in enumerate(path))

        best = max(itertools.product(few, repeat=4), key=score)
        assert m.decode(em) == list(best)


def test_decoding_by_stretches_is_decoding_of_the_whole(tagger, monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["", "a", "plain words"]
    for n in range(40):
        parts = [w for _ in range(n % 5) for w in (*pii.identifier(rng, pii.KINDS[n % 5]), " ", pii.look_alike(rng), " some words ")]
        texts.append("words at the start " * (n % 3) + "".join(parts) + "and more " * (n % 7) * 10)
    for m in (tagger, pii.Tagger.fresh(rng)):
        whole = []
        for t in texts:
            em = pii.merged_emissions(m, [(pii.char_ids(t), 0, len(t))])[0]
            whole.append(pii.tag_spans(m.decode(em), 0) if t else [])
        assert pii.added_spans(m, texts) == whole
        monkeypatch.setattr(pii, "SLAB", 100)
        assert pii.added_spans(m, texts) == whole
        monkeypatch.undo()


def test_windows_are_read_without_their_padding(tagger, monkeypatch):
    """The same emissions as from windows padded to full length, from no more steps than the windows have characters."""
    rng = np.random.default_rng(9)
    codes = [rng.integers(1, pii.N_CHARS, n).astype(np.uint8) for n in (1, 2, 15, 16, 17, 100, 255, 256, 257, 471, 472, 473, 1500)]
    read, whole = [], pii.Tagger.read
    monkeypatch.setattr(pii.Tagger, "read", lambda m, ws: read.extend(map(len, ws)) or whole(m, ws))
    found = pii.merged_emissions(tagger, [(c, 0, len(c)) for c in codes])
    windows = [max(1, -(-(len(c) - pii.WINDOW) // pii.STEP) + 1) for c in codes]
    assert sum(read) == sum(len(c) + pii.OVERLAP * (n - 1) for c, n in zip(codes, windows, strict=True))
    for c, em in zip(codes, found, strict=True):
        total, weight = np.zeros((len(c), len(pii.TAGS))), np.zeros((len(c), 1))
        starts = range(0, max(1, len(c) - pii.OVERLAP), pii.STEP)
        for s in starts:
            part = c[s : s + pii.WINDOW]
            own = tagger.emissions(tagger.states(np.pad(part, (0, pii.WINDOW - len(part)))[None]))[: len(part), 0]
            w = np.ones((len(part), 1))
            if s:
                w[: pii.OVERLAP] = pii.RISING
            if s < starts[-1]:
                w[pii.STEP :] = 1 - pii.RISING
            total[s : s + len(part)] += w * own
            weight[s : s + len(part)] += w
        assert np.allclose(weight, 1) and np.allclose(em, total, atol=1e-3)


def test_decoding_together_is_decoding_alone(tagger):
    rng = np.random.default_rng(10)
    parts = [(rng.normal(0, 3, (n, len(pii.TAGS))).astype(np.float32), n % 2 == 0, n % 3 == 0) for n in (1, 5, 1, 40, 7, 2, 40, 3, 12)]
    assert tagger.decode_all(parts) == [tagger.decode(*p) for p in parts]


def test_model_adds_what_patterns_do_not_hold(tagger):
    text = 'write to ann.lee at mail dot example dot org now. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more words'
    far = "plain words of some text that goes on for quite a while " * 400
    for t in (text, far + text + far):
        base, spans = pii.find_all(tagger, [t])[0]
        assert base == [] and {(k, t[a:b]) for k, a, b in spans} == {
            ("email", "ann.lee at mail dot example dot org"),
            ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        }
    assert pii.find_all(tagger, [far])[0] == ([], [])


def test_personal_data_rows(spark, tagger, docs, empty):
    rows = [(0, None), (1, ""), (2, "mail to ann@x.org now, card 4111.1111.1111.1111 ok"), (3, "x" * 500 + " 10.0.0.1 " + "y" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.span_digests(pii.find_personal_data(df, model=tagger)).collect()}
    assert found[0].spans == found[1].spans == "" and found[2].spans.startswith("email:8:17") and found[2].n_email == 1
    assert found[3].spans == "ip:501:509"
    assert pii.find_personal_data(docs, model=tagger).count() == len(TEXTS) + 1
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(df, model=tagger).collect()}
    assert masked[0] is None and masked[3] == "x" * 500 + " [IP] " + "y" * 500
    assert pii.find_personal_data(empty, model=tagger).collect() == []
    clash = df.select("doc_id", "text", F.lit(1).alias("base"), F.lit("q").alias("spans"), F.lit(2).alias("n_ip"))
    assert {r.doc_id: r.spans for r in pii.span_digests(pii.find_personal_data(clash, model=tagger)).collect()} == {k: r.spans for k, r in found.items()}
    assert pii.masked("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"
