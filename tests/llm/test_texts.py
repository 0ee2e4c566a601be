"""Chat formatting, language model, URL filters, HTML and the classifier."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import helpers
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetlens.llm import chat, html, lm, quality, queries, tokens, urlfilter

CHAT = "conv_id long, turn long, role string, text string"
NASTY = st.lists(st.sampled_from([*"\\#<>/ aé\n:", "### User: ", "</turn>", "</turn>\n", "### Assistant: ", "### Role "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool: x", ""]), NASTY), max_size=6))
def test_round_trip(turns) -> None:
    template = chat.ChatTemplate()
    codec = chat.Codec(template)
    whole = "".join(template.head(r) + codec.escape(t) + template.end for r, t in turns)
    assert [(r, t) for r, t, _ in codec.turns(whole)] == turns


def test_chat_digests(spark) -> None:
    hostile = queries.HOSTILE
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", "x"), (None, 0, "user", "q"), (3, 0, None, ""), (-7, 0, "user", hostile), (-7, 1, "assistant", hostile), (4, 0, "user", "é" * 70_000), (4, 0, "user", "again")]
    frame = spark.createDataFrame([(*r, "k", True) for r in rows], CHAT + ", segment string, loss boolean")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and found[1]["loss_sha256"] == sha("b") and found[1]["valid"]
    assert not found[2]["valid"] and not found[None]["valid"] and not found[4]["valid"]
    assert found[-7]["loss_chars"] == len(hostile) and found[-7]["n_turns"] == 2
    assert found[3]["turns_sha256"] == sha("\n\n")
    assert found[4]["turns_sha256"] == sha("user\nagain\nuser\n" + "é" * 70_000 + "\n")
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_segments_may_lie_anywhere(spark, tmp_path) -> None:
    """Dealt at random, written and read again, segments give the digests that they give in order; vouching for a wrong order raises."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} ### User: of {c}") for c in (1, 2, None) for t in range(10)]
    segments = chat.format_chats(spark.createDataFrame(rows, CHAT))
    wanted = sorted(map(tuple, chat.read_back(segments, in_order=True).collect()), key=str)
    segments.repartition(7, F.rand(3)).write.parquet(str(tmp_path / "dealt"))
    dealt = spark.read.parquet(str(tmp_path / "dealt"))
    assert sorted(map(tuple, chat.read_back(dealt).collect()), key=str) == wanted and [r[1] for r in wanted] == [10, 10, 10]
    cut = segments.where("conv_id = 1").orderBy("seq", "part").repartitionByRange(2, "seq").sortWithinPartitions("seq", "part")
    with pytest.raises(Exception, match="come together"):
        chat.read_back(cut, in_order=True).collect()
    assert chat.read_back(segments.limit(0)).count() == 0


def test_words_match_the_plain_rule() -> None:
    texts = ["", "A b\tC\x0b\x0cd", "é ÉA\x1cb  ", None, " x ", "\u00a0y z", "w" * 5000]
    found = [[p.word(i).decode() for i in range(p.first[t], p.first[t + 1])] for p in tokens.pieces(pa.array(texts)) for t in range(p.n_texts)]
    assert found == [helpers.words(t) for t in texts]


def brute_lm(train: list[list], texts: list[list]) -> list[float]:
    uni, pairs = Counter(), Counter()
    for w in train:
        before = "<s>"
        for x in [*w, None]:
            uni[x] += 1
            pairs[before, x] += 1
            before = x
    classes = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    follow = Counter(w for _, w in pairs)
    d2, d1 = lm.discounts(classes(pairs)), lm.discounts(classes(follow))
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        total[v] += c
        kinds[v][min(c, 3) - 1] += 1
    n, vocab = len(pairs), len(uni)
    more = [sum(v == 1 for v in follow.values()), sum(v == 2 for v in follow.values()), sum(v >= 3 for v in follow.values())]
    floor = sum(d1[k + 1] * more[k] for k in range(3)) / n
    low = lambda w: max(follow[w] - d1[min(follow[w], 3)], 0) / n + floor / (vocab + 1)

    def p(v, w):
        if not total[v]:
            return low(w)
        c = pairs[v, w]
        return max(c - d2[min(c, 3)], 0) / total[v] + sum(d2[k + 1] * kinds[v][k] for k in range(3)) / total[v] * low(w)

    return [sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t], [*t, None], strict=True)) for t in texts]


def test_language_model(spark, docs, corpus) -> None:
    train = {i: t for i, t in corpus.items() if i % 3}
    model = lm.train(docs.where("doc_id % 3 != 0"))
    found = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    wanted = brute_lm([helpers.words(t) for t in train.values()], [helpers.words(t) for t in corpus.values()])
    assert [found[i]["_score"] for i in corpus] == pytest.approx(wanted, rel=1e-9)  # score is a column of docs already
    counts = Counter(w for t in train.values() for w in [*helpers.words(t), None])
    assert model.n_tokens == sum(counts.values()) and model.n_words == len(counts)
    for i, text in corpus.items():
        said = [*helpers.words(text), None]
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (len(said), sum(counts[w] > 0 for w in said))


def brute_lm_of(order: int, train: list[list], texts: list[list]) -> list[float]:
    """Modified Kneser-Ney of any order, by dictionaries of word tuples; one start before a text."""
    raw: dict[tuple, int] = Counter()
    for w in train:
        said = ["<s>", *w, None]
        for k in range(1, order + 1):
            raw.update(tuple(said[i : i + k]) for i in range(len(said) - k + 1) if k > 1 or i)
    before: dict[tuple, set] = defaultdict(set)
    for g in raw:
        if len(g) > 1:
            before[g[1:]].add(g[0])
    # What opens texts has nothing before it, and keeps its count.
    count = {g: c if len(g) == order or g[0] == "<s>" else len(before[g]) for g, c in raw.items()}
    classes = lambda k: [sum(c == x for g, c in count.items() if len(g) == k) for x in (1, 2, 3, 4)]
    d = {k: lm.discounts(classes(k)) for k in range(1, order + 1)}
    after: dict[tuple, list[int]] = defaultdict(list)
    for g, c in count.items():
        after[g[:-1]].append(c)

    def p(context: tuple, w: str | None) -> float:
        low = p(context[1:], w) if context else 1 / (len(after[()]) + 1)
        own = after.get(context)
        if not own:
            return low
        k, c = len(context) + 1, count.get((*context, w), 0)
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(x, 3)] for x in own) * low) / sum(own)

    out = []
    for t in texts:
        said = ["<s>", *t, None]
        out.append(sum(math.log10(p(tuple(said[max(0, i - order + 1) : i]), said[i])) for i in range(1, len(said))))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_models_of_each_order(spark, docs, corpus, order) -> None:
    train = [helpers.words(t) for i, t in corpus.items() if i % 3]
    wanted = brute_lm_of(order, train, [helpers.words(t) for t in corpus.values()])
    found = {r["doc_id"]: r["_score"] for r in lm.score(docs, lm.train(docs.where("doc_id % 3 != 0"), order)).collect()}
    assert [found[i] for i in corpus] == pytest.approx(wanted, rel=1e-9)
    if order == 2:
        assert wanted == pytest.approx(brute_lm(train, [helpers.words(t) for t in corpus.values()]), rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_short_texts_and_hot_pairs(spark, order) -> None:
    """Texts that only open, pairs that no word comes before, one pair hot in many parts; parts don't change a score."""
    train = [f"w{i % 7} w{i % 11}" for i in range(200)] + ["", "alone"] + ["hot pair"] * 200 + [f"x{i} hot pair y{i % 3}" for i in range(50)]
    texts = ["", "alone", "zzz", "hot pair", "zzz hot pair y1", "x1 hot pair", "w1 w2 zzz w1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for slices in (1, 30):
        model = lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(slices), order)
        found = [r["score"] for r in lm.score(frame, model).orderBy("doc_id").collect()]
        assert found == pytest.approx(brute_lm_of(order, [helpers.words(t) for t in train], [helpers.words(t) for t in texts]), rel=1e-9)


def test_language_model_with_a_spread_start(spark) -> None:
    """The start of texts is hot in many parts; an unknown word before a word doesn't hide that the word starts texts."""
    train = [f"w{i % 7} w{i % 11}" for i in range(200)]
    texts = [f"w{i % 7} zzz w{i % 7}" for i in range(40)]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(40))
    assert model.n_texts * model.parts * 2 > model.n_tokens
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["score"] for r in lm.score(frame, model).orderBy("doc_id").collect()]
    assert found == pytest.approx(brute_lm([helpers.words(t) for t in train], [helpers.words(t) for t in texts]), rel=1e-9)


def test_language_model_without_training(spark) -> None:
    frame = spark.createDataFrame([("a b",), (None,)], "text string")
    rows = lm.score(frame, lm.train(frame.limit(0))).collect()
    assert [r["n_tokens"] for r in rows] == [3, 1] and all(math.isfinite(r["score"]) for r in rows)
    assert lm.score(frame.limit(0), lm.train(frame)).count() == 0


URLS = [
    ("https://www.example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://A.Example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("ftp://x.net/fr/9#top", "x.net", "/fr/9", "net/fr/", "block"),
    ("http://x.net/de/9", "x.net", "/de/9", None, "allow"),
    ("http://host.org", "host.org", "", None, "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://h.org?q=://z.net/es/1", "h.org", "", None, "allow"),
]


def test_urls(spark) -> None:
    frame = spark.createDataFrame([(i, u[0], "old", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, template int")
    rows = urlfilter.filter_urls(frame, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["_host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [u[1:] for u in URLS]
    assert urlfilter.filter_urls(frame.limit(0), queries.URL_RULES).count() == 0


def test_templates_are_rejected_by_purity(spark) -> None:
    pages = [(i, f"http://h.org/{'spam' if i % 2 else 'good'}/{i}/item-{i}.html") for i in range(200)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = frame.where("page_id < 120").select("url", (F.col("page_id") % 2 == 1).alias("blocked"))
    found = {r["page_id"]: (r["verdict"], r["template"]) for r in urlfilter.filter_urls(frame, (), labels).collect()}
    assert all(found[i][0] == ("block" if i % 2 else "allow") for i in range(200))
    assert {t for _, t in found.values()} == {"/spam/*/*", "/good/*/*"}


def test_templates_without_labels_ask_their_ancestors(spark) -> None:
    """An unruled page is blocked where enough labelled branches around it are, and one blocked branch says nothing about its siblings."""
    pages = [(f"http://h.org/spam/kind{k}/{i}", True) for k in range(12) for i in range(1, 4)] + [(f"http://h.org/good/kind{k}/{i}", False) for k in range(12) for i in range(1, 4)]
    asks = ["http://h.org/spam/kind99/1/2/3/4/5/6/7/8/9/x", "http://h.org/spam/other", "http://h.org/good/other", "http://h.org/news/1", "http://one.org/de/1"]
    told = [*pages, ("http://one.org/es/1", True), ("http://one.org/es/2", True)]
    labels = spark.createDataFrame(told, "url string, blocked boolean")
    frame = spark.createDataFrame([(u,) for u, _ in told] + [(u,) for u in asks] + [(asks[0],)], "url string")
    found = {r["url"]: (r["verdict"], r["template"]) for r in urlfilter.filter_urls(frame, (), labels).collect()}
    assert [found[u][0] for u in asks] == ["block", "block", "allow", "allow", "allow"]
    assert found[asks[0]][1] == "/spam/kind99/*/*/*/*/*/*/*/*/*/x"  # as deep as the path is
    assert all(found[u][0] == ("block" if bad else "allow") for u, bad in pages)  # two labelled pages, as on one.org, are too few


def test_verdicts_of_a_host_do_not_depend_on_other_hosts(spark, sf) -> None:
    """The pages of half of the hosts are judged alone as they are among all, and by labels that are nearly all blocked as by others."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    half = pages.where(F.crc32(urlfilter.host_of(F.col("url"))) % 2 == 0)
    spam = spark.createDataFrame([(10**9 + i, f"http://spam{i}.example.net/es/{i}") for i in range(3000)], pages.schema)
    judged = lambda rows: {r["page_id"]: tuple(r)[2:] for r in urlfilter.filter_urls(rows, queries.URL_RULES).collect()}
    alone, among = judged(half), judged(pages.unionByName(spam))
    assert 0 < len(alone) < len(among) and all(among[k] == v for k, v in alone.items())


def test_unruled_pages_of_blocked_hosts(spark) -> None:
    """The method decides unruled pages: they are blocked on a host whose labelled pages are all blocked, if these are enough, and not on a host of as many allowed ones."""
    told = [(f"http://{h}.org/{part}/{i}", h == "bad" or part == "es") for h in ("bad", "mixed") for part in ("es", "fr") for i in range(6)] + [(f"http://mixed.org/it/{i}", False) for i in range(6)]
    asks = ["http://bad.org/de/1", "http://mixed.org/de/1", "http://none.org/de/1"]
    frame = spark.createDataFrame([(u,) for u, _ in told] + [(u,) for u in asks], "url string")
    found = {r["url"]: r["verdict"] for r in urlfilter.filter_urls(frame, (), spark.createDataFrame(told, "url string, blocked boolean")).collect()}
    assert [found[u] for u in asks] == ["block", "allow", "allow"]


def test_unruled_pages_that_the_method_blocks(spark, sf) -> None:
    """On the query's own table and rules the method blocks pages, only on hosts of which no page is allowed by a rule."""
    rows = queries.QUERIES["op4_url_filter"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    blocked = {r["host"] for r in rows if r["rule"] is None and r["verdict"] == "block"}
    assert blocked and not blocked & {r["host"] for r in rows if r["rule"] is not None and r["verdict"] == "allow"}


def test_rare_children_at_several_levels(spark) -> None:
    """Rare children merge at their topmost level first, and what they merge counts at the next."""
    pages = [f"http://h.org/u{i}/x{i % 30}/end" for i in range(60)] + ["http://h.org/big/x/end"] * 90 + [f"http://h.org/{i}/x{i % 30}/end" for i in range(40)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    found = {r["template"] for r in urlfilter.filter_urls(frame, ()).collect()}
    assert found == {"/*/*/end", "/big/x/end"}


def test_very_deep_paths(spark) -> None:
    """Two crawler traps of 3,000 segments that part at their ends cost as many rounds as short paths."""
    trap = "http://h.org/" + "/".join(["a", "b1", "20"] * 1000)
    frame = spark.createDataFrame([(1, trap + "/x"), (2, trap + "/y"), (3, "http://h.org/a/z")], "page_id long, url string")
    began = time.time()
    found = {r["page_id"]: r["template"] for r in urlfilter.filter_urls(frame, queries.URL_RULES).collect()}
    assert found[1] == "/" + "/".join(["a", "b1", "*"] * 1000) + "/x" and found[3] == "/a/z" and time.time() - began < 90


def test_urls_with_long_paths_and_repeated_rows(spark) -> None:
    deep = "http://h.org/" + "/".join(f"part{i}" for i in range(30))
    long = "http://h.org/" + "x" * 100_000
    rows = [(1, deep), (1, deep), (2, long), (3, "http://h.org"), (4, "http://h.org///a//b")]
    found = sorted((r["page_id"], r["template"], r["verdict"]) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect())
    assert found == sorted([(1, deep[12:], "allow")] * 2 + [(2, long[12:], "allow"), (3, "", "allow"), (4, "/a/b", "allow")])


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header class='site'>Site</header><nav><a href=/>Home</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>One <b>two</b>\n  three<br>four</p><div class=\"ad\">Buy</div><p>x&lt;y &#233;</p>"
    "<form><input value=1>send</form><section id=comments>me too</section></article><aside>side</aside><footer>&copy; end</footer></body></html>"
)


def test_html(spark) -> None:
    plain = "".join(f"<div>menu one two three four five six seven eight nine</div><div>n{{}} body {w}</div>" for w in ("a",))
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", None), (3, None, ""), (4, "http://a.org/4", "just text  here"), (5, "http://b.org/", "<article>cut off <b>here")]
    rows += [(10 + i, "http://c.org/", plain.format(i)) for i in range(5)]
    rows.append((1, "http://a.org/1", PAGE))
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, _host int")
    out = html.main_text(frame)
    assert out.columns == ["page_id", "url", "text", "_host", "_text", "n_chars"]
    found = {r["page_id"]: r["_text"] for r in out.collect()}
    assert found[1] == "Title & more One two three four x<y é"
    assert (found[2], found[3], found[4], found[5]) == ("", "", "just text here", "cut off here")
    assert found[12] == "n2 body a"  # the menu repeats on five distinct pages of the host
    assert out.count() == len(rows) and html.main_text(frame.limit(0)).count() == 0


def test_html_repeats_count_over_a_whole_host(spark) -> None:
    """A notice on 20 of 2,000 pages of a host, a copied page, and the same notice on two pages of another host."""
    notice = "<div>sign up here for our weekly letter and all the news</div>"
    rows = [(i, f"http://big.org/{i}", f"<div>page n{i} says w{i}</div>" + (notice if i % 100 == 0 else "")) for i in range(2000)]
    rows += [(3000 + i, "http://copies.org/", f"{notice}<p>one") for i in range(500)] + [(4000, "http://copies.org/2", f"{notice}<p>two")]
    found = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)).collect()}
    assert len(found) == len(rows) and all(found[i] == f"page n{i} says w{i}" for i in range(2000))
    assert found[3001] == "sign up here for our weekly letter and all the news one" and found[4000].endswith("news two")


def test_html_repeats_decide_inside_articles(spark) -> None:
    """A notice in a plain element of every article goes; a passage that a few articles quote stays."""
    notice, quote = "<div>sign up here for our weekly letter and all the news</div>", "<p>a passage of ten words that only three articles quote</p>"
    pages = [f"<article><p>page n{i} says w{i}</p>{quote if i % 10 == 0 else ''}{notice}</article>" for i in range(30)]
    said = [f"page n{i} says w{i}" + (" a passage of ten words that only three articles quote" if i % 10 == 0 else "") for i in range(30)]
    assert html.extract(pages) == said
    small = [p for i, p in enumerate(pages) if i in (1, 2, 3)]
    assert html.extract(small) == [f"page n{i} says w{i} sign up here for our weekly letter and all the news" for i in (1, 2, 3)]
    frame = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    assert [r["text"] for r in html.main_text(frame).orderBy("page_id").collect()] == said


def test_html_against_brute_force(spark) -> None:
    """Pages of several hosts, with and without articles, repeats counted in plain Python over the whole host."""
    r = random.Random(8)
    phrase = lambda k: " ".join(f"p{k}w{j}" for j in range(r.choice([5, 8, 11])))
    stock, notice = [phrase(k) for k in range(12)], " ".join(f"notice{j}" for j in range(9))
    say = lambda: " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 12)))
    body = lambda: "".join(f"<{t}>{r.choice([say(), r.choice(stock), say() + ' ' + r.choice(stock) + ' ' + say(), 'body'])}</{t}>" for t in r.choices(["p", "div", "li"], k=r.randint(1, 8)))
    rows = []
    for i in range(240):
        page = r.choice([*[lambda: f"<main>{body()}<div>{notice}</div></main>"] * 4, body, lambda: f"{body()}<nav>menu</nav>{body()}"])()
        rows.append((i, f"http://h{i % 3}.org/{i}", page))
    rows += [(300 + i, "http://h0.org/x", rows[0][2]) for i in range(5)]
    by_host: dict = defaultdict(dict)
    for _, url, page in rows:
        by_host[url.split("/")[2]][page] = None

    def stream(page: str) -> list:
        out = []
        for b, (kind, marks, text) in enumerate(html.blocks(page)):
            out += [(m, None, None) for m in marks.replace("><", "> <").split()] + [(w, b, kind) for w in text.split()]
        return out

    wanted = {}
    for host, kinds in by_host.items():
        seen: dict = defaultdict(set)
        for page in kinds:
            s = [w for w, _, _ in stream(page)]
            for i in range(len(s) - 7):
                seen[tuple(s[i : i + 8])].add(page)
        for page in kinds:
            s = stream(page)
            marked = any(kind == html.ARTICLE_TEXT for _, _, kind in s)
            stake = html.ARTICLE_TEXT if marked else html.PLAIN
            least = max(html.ARTICLE_PAGES, html.SHARE * len(kinds)) if marked else html.PAGES
            covered, within = set(), set()
            for i in range(len(s) - 7):
                if len(seen[tuple(w for w, _, _ in s[i : i + 8])]) >= least:
                    covered |= set(range(i, i + 8))
                    if s[i][1] is not None and s[i][1] == s[i + 7][1]:
                        within |= set(range(i, i + 8))
            kept: list = []
            for b in sorted({b for _, b, _ in s if b is not None}):
                own = [i for i, x in enumerate(s) if x[1] == b]
                if s[own[0]][2] == stake and not set(own) <= covered:
                    kept += [s[i][0] for i in own if i not in within]
            wanted[host, page] = " ".join(kept)
    found = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert found == {i: wanted[url.split("/")[2], page] for i, url, page in rows}
    without = {i: " ".join(w for w, b, kind in stream(page) if b is not None and kind == (html.ARTICLE_TEXT if "<main>" in page else html.PLAIN)) for i, _, page in rows}
    changed = {i for i, *_ in rows if found[i] != without[i]}
    # The repeats decide on pages with an article and on pages without.
    assert any("<main>" in page for i, _, page in rows if i in changed) and any("<main>" not in page for i, _, page in rows if i in changed)


def test_words_after_repeated_markup_stay() -> None:
    """A run that ends inside a block doesn't cut the block's first word."""
    pages = [f"<div>menu one two three four five six seven</div><div>body {i}</div>" for i in range(6)]
    assert html.extract(pages) == [f"body {i}" for i in range(6)]


def test_html_of_a_very_long_page(spark) -> None:
    text = " ".join(f"w{i}" for i in range(300_000))
    frame = spark.createDataFrame([(1, "http://a.org/", f"<nav>x</nav><article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert html.main_text(frame).first()["text"] == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='has-sidebar'><div class='page with-sidebar'><main><p>in</p></main><div class=sidebar>out</div></div>", "in"),
        ("<article><header class=entry-header><h1>Title</h1></header><p>in</p><footer>tags</footer></article>", "Title in"),
        ("<div id=header>top</div><main>in<ul class='comment-list'><li>no</li></ul><p>also</main>", "in also"),
        ("<article>in</article><div class=related><article>teaser</article></div>", "in"),
        ("<article class=comment>no</article><article>in</article>", "in"),
        ("<p>a<script>if (x < y) '</p>'</script>b<style>c</style><!-- <p>d --><p>e &lt;p&gt; &nbsp; f", "ab e <p> f"),
        ("<article><p>a</p><div hidden>b</div><div role=alert>c</div><span class='ad'>d</span>e<svg><text>f</text></svg></article>", "a e"),
        ("<textarea>no</textarea><title>no</title>yes < no tag", "yes < no tag"),
        ("<article>a<![CDATA[b<c]]>d<? php ?>e<br/>f</article>tail", "ab<cde f"),
    ],
)
def test_blocks(page, text) -> None:
    assert html.extract([page]) == [text]


def test_suffixes_find_every_long_repeat() -> None:
    r = random.Random(3)
    n = 400
    tokens_, page = np.array([r.randrange(4) for _ in range(n)]), np.sort(np.array([r.randrange(12) for _ in range(n)]))
    for length, least in ((3, 2), (5, 3), (8, 2)):
        seen = defaultdict(set)
        spans = [(i, tuple(tokens_[i : i + length])) for i in range(n - length + 1) if page[i] == page[i + length - 1]]
        for i, s in spans:
            seen[s].add(page[i])
        wanted = np.zeros(n, bool)
        for i, s in spans:
            if len(seen[s]) >= least:
                wanted[i : i + length] = True
        assert (html.repeated(tokens_, page, length, least) == wanted).all()


def test_classifier(spark) -> None:
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeiounstr") for _ in range(r.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(r.randint(20, 300))) + "."
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(r.randint(20, 300)))
    rows = [(i, (junk if i % 4 == 0 else prose)()) for i in range(400)] + [(1000, None), (1001, ""), (1002, prose() * 800)]
    docs = spark.createDataFrame([(*x, 0.1) for x in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 5) for i in range(200)] + [(3, 1, 5), (7, None, 5), (None, 0, 5)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.learn(docs, labels)).collect()
    by = {x["doc_id"]: x["_score"] for x in scored}
    right = [(by[i] >= 0.5) == (i % 4 != 0) for i in range(200, 400)]
    assert sum(right) / len(right) > 0.97 and by[1000] == by[1001] and by[1002] > 0.5
    assert all(0 <= s <= 1 for s in by.values()) and len(scored) == len(rows)
    nothing = quality.score(docs, quality.learn(docs, labels.limit(0))).select("_score").distinct().collect()
    assert [x["_score"] for x in nothing] == [0.5]
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0


def test_long_documents_enter_the_fit() -> None:
    assert quality.spread(3, 8, 10).tolist() == [3, 4, 5, 6, 7]
    found = quality.spread(10, 1010, 48)
    assert len(set(found.tolist())) == 48 and found[0] == 10 and found[-1] == 1009 and np.all(np.diff(found) > 0)


def test_forward_pass_against_plain_python() -> None:
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality.WIDTH)).astype(np.float32) for n in (1, 2, 4)]
    model = quality.fit(bags, np.array([0.0, 1.0, 0.0], np.float32), epochs=2)
    w = {k: np.array(v, np.float64) for k, v in model.w.items()}
    model.w = w
    scores = model.forward(np.concatenate(bags).astype(np.float64), np.array([0, 1, 3, 7]))[0]
    for bag, score in zip(bags, scores, strict=True):
        hidden, weight = [], []
        for passage in bag.astype(np.float64):
            z = [min(8.0, max(-8.0, (passage[i] - w["mean"][i]) / w["scale"][i])) for i in range(quality.WIDTH)]
            h = [math.tanh(sum(z[i] * w["W"][i, j] for i in range(len(z))) + w["b"][j]) for j in range(len(w["b"]))]
            gate = [math.tanh(sum(h[i] * w["V"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["U"][i, j] for i in range(len(h))))) for j in range(len(w["q"]))]
            hidden.append(h)
            weight.append(math.exp(sum(g * q for g, q in zip(gate, w["q"], strict=True))))
        total = sum(weight)
        pooled = [sum(a / total * h[j] for a, h in zip(weight, hidden, strict=True)) for j in range(len(w["c"]))]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(p * c for p, c in zip(pooled, w["c"], strict=True)) + float(w["d"])))), rel=1e-9)


def test_gradients() -> None:
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0])
    model = quality.fit(bags, y, epochs=1)
    model.w = {k: np.array(v, np.float64) for k, v in model.w.items()}
    x, first = np.concatenate(bags).astype(np.float64), np.array([0, 1, 4, 9])

    def loss() -> float:
        p = model.forward(x, first)[0]
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for name, grad in model.gradients(x, first, y).items():
        flat, g = model.w[name].reshape(-1), np.asarray(grad).reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-6)
