"""Language ID, PPM, HTML, WARC and mixing."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.llm import common, html_text, langid, mixing, ppm, warc
from .data import WORD, documents, frame, lower


def corpus(n=120):
    rng = random.Random(4)
    sounds = {"aa": ["tha", "ing", "sh", "wor"], "bb": ["éau", "oui", "ç", "re"], "cc": ["ung", "sch", "ü", "der"]}
    return [(k, " ".join("".join(rng.choice(sounds[x]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), x) for k, x in enumerate(rng.choice(list(sounds)) for _ in range(n))]


def test_language_of_held_out_texts(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "thaing sh", None), (None, "schung der", "cc"), (905, "tha " * 50_000, "aa"), (3, "tha ing", "aa")]
    docs = spark.createDataFrame([(i, t, x, "s", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, source string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert {of[k].lang_pred for k in (900, 901, 902)} == {"und"} and of[900].score == 0.0
    held = [(i, x) for i, t, x in rows[:120] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(of[i].held_out for i, _ in held) and sum(of[i].lang_pred == x for i, x in held) >= 0.95 * len(held)
    assert of[905].lang_pred == "aa" and of[None].held_out and all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {900, 901, 902}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (5, None, "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))


def plain_bayes(rows):
    """(language, posterior) of each row's text by plain counting."""
    def buckets(text):
        code = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
        for n in langid.ORDERS:
            for p in range(len(code) - n + 1):
                x = 0
                for c in code[p:p + n]:
                    x = (x * 0x110001 + c + 1) % 2**64
                x = (x + (n << 56)) % 2**64
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
                yield (x ^ (x >> 31)) >> 48

    counts, seen = defaultdict(Counter), Counter()
    for i, t, x in rows:
        if t is not None and x is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[x].update(buckets(t))
            seen[x] += 1
    total = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    out = []
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out.append((i, "und", 0.0))
            continue
        grams = Counter(buckets(t))
        joint = {x: math.log(seen[x] / sum(seen.values())) + sum(n * math.log((c[b] + langid.SMOOTHING) / total[x]) for b, n in grams.items()) for x, c in counts.items()}
        best = max(joint.values())
        out.append((i, min(x for x in joint if joint[x] >= best - 1e-9), 1 / sum(math.exp(j - best) for j in joint.values())))
    return out


@pytest.mark.parametrize("one, block, dense", [(512, 128, 64), (512, 128, 1), (2, 1, 1), (2, 2, 64)])
def test_languages_equal_plain_bayes_in_one_matrix_or_many(spark, monkeypatch, one, block, dense):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", one)
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = [(i, t, x + str(i % 2)) for i, t, x in corpus(60)] + [(900, None, "aa0"), (901, "", "aa0"), (902, "12 !", "bb1"), (903, "th", None), (None, "ung", "cc0")]
    rows += [(950, "tha ing", "dd")] * 5 + [(905, "wor " * 2000, "aa1")]
    docs = spark.createDataFrame([(i, t, x, 1, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, k1 int, score double")
    want = plain_bayes(rows)
    got = langid.identify(docs).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: order(r))] == [w[:2] for w in sorted(want, key=order)]
    assert all(abs(r.score - w[2]) < 1e-6 for r, w in zip(sorted(got, key=lambda r: order(r)), sorted(want, key=order)))
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, x, p in want if p >= 0.5)


def test_ppm_equals_a_plain_model(spark):
    rows = documents(8, 15)
    rows = [r for r in rows if len(r[1] or "") < 5000]
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    n = ppm.ORDER
    seen = [defaultdict(Counter) for _ in range(n + 1)]
    tokens = Counter()
    for i, t in rows:
        if learns(i):
            s = bytes([ppm.PAD]) * n + (t or "").encode() + bytes([ppm.END])
            for p in range(n, len(s)):
                for k in range(n + 1):
                    seen[k][s[p - k:p]][s[p]] += 1
            tokens.update([*WORD.findall(lower(t)), None])

    def log_p(context, symbol):
        out, gone = 0.0, set()
        for k in range(n, -1, -1):
            left = {a: c for a, c in seen[k].get(context[n - k:], {}).items() if a not in gone}
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / total)
            out += math.log10(len(left) / 2 / total) if total else 0.0
            gone |= set(left)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    total, kinds = sum(tokens.values()), len(tokens)
    want = []
    for i, t in rows:
        s = bytes([ppm.PAD]) * n + (t or "").encode() + bytes([ppm.END])
        mine = [*WORD.findall(lower(t)), None]
        want.append((i, not learns(i), len(mine), sum(tokens[w] > 0 for w in mine), total,
                     sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in mine), sum(log_p(s[p - n:p], s[p]) for p in range(n, len(s)))))
    got = sorted(map(tuple, ppm.report(frame(spark, rows)).collect()), key=repr)
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_ppm_is_a_distribution():
    import numpy as np
    rng = np.random.default_rng(0)
    data = rng.choice(np.frombuffer(b"abcd ", np.uint8), 400)
    keys, _ = ppm.gram_keys(data, np.array([0, 400]))
    distinct, counts = np.unique(keys, return_counts=True)
    context = int(distinct[7]) >> 8
    other = np.array([(context << 8) | s for s in range(256) if s != ppm.PAD], dtype=np.uint64)
    asked = np.unique(np.concatenate([distinct, other]))
    known = np.zeros(len(asked))
    known[np.searchsorted(asked, distinct)] = counts
    pairs = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=65536)
    same_end = (asked >> np.uint64(8)) & np.uint64(0xFFFF) == np.uint64(context & 0xFFFF)
    log_p = ppm.log_probabilities(asked[same_end], known[same_end], pairs)
    mine = (asked[same_end] >> np.uint64(8)) == np.uint64(context)
    assert (10 ** log_p[mine]).sum() == pytest.approx(1.0)


def test_ppm_without_training_texts(spark):
    empty = ppm.score_texts(frame(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in empty} == {(2, 0, 0), (1, 0, 0)}
    assert next(r.score for r in empty if r.doc_id == 1) == pytest.approx(-3 * math.log10(ppm.SYMBOLS))
    assert ppm.report(frame(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{frame}<article><header><h1>Title {n}</h1></header>
<p>First &amp; <b>bold</b>&nbsp;text
 of {n}.<p>Second &lt;tag&gt;<aside>Related</aside></p><form><label>Mail</label></form><ol class="commentlist"><li>nice!</li></ol></article><section id="user-comments">me too</section>
<div class=sidebar><p>Side</p></div><footer>&copy; host</footer></body></html>"""


def test_main_text_of_articles(spark):
    pages = [(k, f"http://h.org/en/{k}", PAGE.format(n=k, frame="")) for k in range(6)] + [(90, None, None), (91, "http://x/", ""), (92, "not a url", "<p>plain"), (92, "not a url", "<p>plain"), (93, "http://h.org/en/9", "<p>a < b &eacute;<br>c</p><!-- x --><p> </p>")]
    got = sorted(map(tuple, html_text.extract(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, key string")).collect()))
    want = [(k, u, f"Title {k}\nFirst & bold text of {k}.\nSecond <tag>") for k, u, _ in pages[:6]] + [(90, None, ""), (91, "http://x/", ""), (92, "not a url", "plain"), (92, "not a url", "plain"), (93, "http://h.org/en/9", "a < b é c")]
    assert got == [(*w, len(w[2])) for w in want]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_template_lines_are_deleted_without_markup(spark):
    """Pages without article or chrome elements: the diff with the nearest page finds the template."""
    body = "<div>Welcome to our site</div><div>Menu one</div><p>Story {a} has its own long first sentence.</p><p>And {b} a second one to tell.</p><div>All rights reserved</div>"
    pages = [(k, f"http://s.net/news/{k:03d}", body.format(a=f"a{k}", b=f"b{k}")) for k in range(9)] + [(50, "http://s.net/news/004?copy", body.format(a="a4", b="b4"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2] == "Story a2 has its own long first sentence.\nAnd b2 a second one to tell."
    assert got[50].startswith("Story a4") and got[4].startswith("Story a4")


def test_copies_do_not_hide_the_template(spark):
    """Runs of copies and captures, and short pages whose template is most of their text, without markup."""
    menu, legal = "Welcome to the site of all the news there are", "All rights reserved by the people of this site"
    def page(*story):
        return "".join(f"<div>{t}</div>" for t in (menu, *story, legal))
    story = lambda k: f"Story {k} has a long first sentence of its own, and more {k * k} words to come after it, as stories have."
    pages = [(k, f"http://s.net/n/{k:03d}", page(story(k))) for k in range(40)]
    pages += [(100 + k, "http://s.net/n/020", page(story(20))) for k in range(5)]  # equal captures
    pages += [(200 + k, "http://s.net/n/030", page(story(30), f"seen {k}")) for k in range(5)]  # captures
    pages += [(300 + k, f"http://s.net/n/010?s={k}", page(story(10), f"seen {k}")) for k in range(5)]  # copies at adjacent URLs
    pages += [(400 + k, f"http://short.org/{k}", page(f"Short story {k}.")) for k in range(6)]
    pages += [(500 + k, f"http://copies.org/?s={k}", f"<p>{story(7)}</p><p>{story(8)}</p><p>no {k}</p>") for k in range(4)]
    pages += [(600 + k, f"http://marked.org/{k}", f"<p>By someone</p><article><p>{story(k // 4)}</p></article><p>{menu}</p>") for k in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    assert all(got[k] == story(k) for k in range(40))
    assert all(got[100 + k] == story(20) and got[200 + k] == f"{story(30)}\nseen {k}" and got[300 + k] == f"{story(10)}\nseen {k}" for k in range(5))
    assert [got[400 + k] for k in range(6)] == [f"Short story {k}." for k in range(6)]
    assert all(got[500 + k] == f"{story(7)}\n{story(8)}\nno {k}" for k in range(4))
    assert [got[600 + k] for k in range(8)] == [story(k // 4) for k in range(8)]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.shared_lines(a, b)) == best[-1][-1]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "BATCH_BYTES", 60)
    pages = [(k, f"http://h{k % 3}.org/p?{k // 2}", "<p>same</p>" if k % 4 == 0 else f"é{k}" * k) for k in range(40)]
    pages += [(77, None, None), (78, "http://h0.org/", None), (None, "http://[bad", "x\r\n\r\ny"), (78, "http://h0.org/", None), (-5, "http://h0.org/ a", "big" * 100_000)]
    table = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, key string")
    least = {}
    for i, _, h in pages:
        least.setdefault(h or "", []).append(float("inf") if i is None else i)
    want = []
    for i, _, h in pages:
        raw, first = (h or "").encode(), min(least[h or ""])
        other = first != (float("inf") if i is None else i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", first if other else None))
    assert sorted(map(tuple, warc.report(table).collect()), key=repr) == sorted(want, key=repr)
    path, top, _ = warc.write_archives(table)
    found = warc.lookup(path, top, spark.createDataFrame([("http://h1.org/p?5",), ("http://nowhere/",), (None,)], "url string")).collect()
    assert sorted((r.page_id, r.payload is None) for r in found) == [(10, False), (77, False)]
    assert warc.url_key("http://A.b.C/d?e") == "c,b,a)/d?e"
    assert warc.report(table.limit(0)).count() == 0


def mix_rows(rows):
    return [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 5}" if (i or 0) % 7 else None) for i, t in rows]


def test_mix_equals_sql(spark, tmp_path):
    rows = mix_rows([r for r in documents(9) if r[0] is not None])
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = mixing.report(docs)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(mixing.SQL).fetchall())
    total = sum(len(WORD.findall((t or "").encode())) for _, t, *_ in rows)
    taken = got.agg(F.sum("tokens_taken")).first()[0]
    assert 0 <= int(total * mixing.SHARE) - taken < 60  # shares round down


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, language string, leaf string, tokens long")
    got = {r.leaf: r.budget for r in mixing.allot(leaves, 0.2, 1, {}, {}, {}).collect()}
    assert got == {"a": 10, "b": 191, "c": 201}
    all_of = {r.leaf: r.budget for r in mixing.allot(leaves, 9.0, 2, {"d1": 5}, {}, {}).collect()}
    assert all_of == {"a": 20, "b": 2000, "c": 2000}


def test_mix_of_dirty_rows(spark):
    rows = mix_rows(documents(9))
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, tokens_taken int")
    assert mixing.report(docs).count() == len(rows)
    taken = mixing.taken_rows(docs)
    assert taken.columns == ["doc_id", "text", "lang", "source", "n_tokens", "epochs", "tokens_taken"] and taken.filter("tokens_taken <= 0").count() == 0
    assert mixing.report(docs.limit(0)).count() == 0 and mixing.taken_rows(docs.filter("text is null")).count() == 0


@pytest.mark.parametrize("piece", [
    '<svg class="i"/>', "<svg-icon name=x></svg-icon>", "<button-group></button-group>", "<title-bar>", "<select-box/>", "<svg_x>", "<svg><title/><style/></svg>", "<svg><path d='M0'/><title>Icon</title></svg>",
    "<button>Buy</button>", "<button><p>Buy</p></button>", "<b><button>Buy</b></button>", "<select><option>Buy</select>", "<object><p>Buy</p></object>", "<template><article>Buy</article></template>", "<noscript><p>Buy</p></noscript>",
    "<iframe src=x />", "<iframe>Buy</iframe>", "<button>Buy", "<select><option>Buy", "<object data=x>Buy", "<svg><path>", "<button>Buy<svg>", "<ul><li><button>Buy</li></button></ul>", "<title>Buy</title >", "<script>'<p>Buy</p>'</script>", "<style/>Buy</style>"])
def test_no_element_takes_the_rest_of_the_article_away(piece):
    for around in ("<article>{}</article><footer>end</footer>", "<div><article>{}<p>three</p></article><svg/></div>"):
        page = around.format(f"<p>one</p>{piece}<p>two</p>")
        got = [t for t, zone in html_text.page_lines(page) if zone == html_text.ARTICLE]
        assert got == ["one", "two", "three"][:2 + ("three" in page)], page
    assert [t for t, zone in html_text.page_lines(f"<p>one</p>{piece}<p>two</p>") if zone != html_text.CHROME] == ["one", "two"]
    assert html_text.page_lines("<p>one<svg/> and<button>Buy<p>x</p></button> two</p>")[0][0] == "one and two"
    assert html_text.page_lines("<p>one</p><script>rest<p>two</p>") == [("one", html_text.NEUTRAL)]
