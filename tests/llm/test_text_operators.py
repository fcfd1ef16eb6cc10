"""Brute force, round trips and odd cases of the operators on single texts."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from vitalgauge.llm import chat, decontaminate, fingerprint, html_text, language, pieces, quality, token_files, url_filter


def plain_distance(pattern, text):
    previous = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(previous[j - 1] + (a != b), previous[j] + 1, row[-1] + 1))
        previous = row
    return min(previous)


def test_myers_distance_equals_dynamic_programming():
    draw = random.Random(1)
    for _ in range(300):
        pattern = "".join(draw.choice("abc") for _ in range(draw.randint(1, 14)))
        text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 25)))
        assert decontaminate.best_end(decontaminate.pattern_masks(pattern), len(pattern), text)[0] == plain_distance(pattern, text)


def test_items_are_found_with_edits_within_budget_and_not_beyond():
    draw = random.Random(2)
    item = "".join(draw.choice("abcdefgh ij") for _ in range(120)).strip()
    item = " ".join(item.split())
    matcher = decontaminate.Matcher([(7, item), (8, item), (9, "short")])
    budget = int(decontaminate.RATE * len(item))
    for edits in (0, 1, budget):
        chars = list(item)
        for at in range(edits):
            chars[7 + at * 15] = "#"
        found = matcher.find("before  " + "".join(chars).upper() + "\nafter")
        assert [(i, d) for i, d, _, _ in found] == [(7, edits), (8, edits)]
    chars = list(item)
    for at in range(3 * budget):
        chars[at * 6] = "#"
    assert matcher.find("".join(chars)) == [] and matcher.find(None) == [] and matcher.find("") == []


def test_find_items_on_odd_tables(spark, odd_documents, no_documents):
    items = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog near the river"), (2, None), (3, ""), (1, "x")], "item_id bigint, text string"
    )
    rows = {(r.doc_id, r.item_id) for r in decontaminate.find_items(odd_documents, items).collect()}
    assert rows == {(1, 1), (None, 1)}
    assert decontaminate.find_items(no_documents, items).count() == 0
    assert decontaminate.find_items(odd_documents, items.limit(0)).count() == 0
    flagged = decontaminate.contaminated(odd_documents, items, out="quality", block_chars=10)
    assert flagged.where("quality").count() == 3 and flagged.count() == odd_documents.count()
    assert not decontaminate.contaminated(odd_documents, items.limit(0)).where("contaminated").count()


def all_segmentations(vocabulary, text):
    found = []

    def go(at, score, ids):
        if at == len(text):
            found.append(score)
            return
        if text[at] not in vocabulary.entries:
            spelled = vocabulary.spelled(text[at])
            go(at + 1, score + vocabulary.byte_score * len(spelled), ids)
        for end in range(at + 1, len(text) + 1):
            hit = vocabulary.entries.get(text[at:end])
            if hit:
                go(end, score + hit[1], ids)

    go(0, 0, [])
    return sorted(found, reverse=True)


def test_n_best_equals_enumeration_and_decoding_restores():
    vocabulary = pieces.Pieces.load(pieces.default_model())
    five, two = pieces.Encoder(vocabulary, 5), pieces.Encoder(vocabulary, 2)
    draw = random.Random(3)
    for _ in range(150):
        text = "".join(draw.choice("the an.ingeré\n日▁") for _ in range(draw.randint(1, 10)))
        best = five.encode_n(text)
        body = text.replace("▁", pieces.OWN_MARK).replace(" ", "▁")
        assert [s for s, _ in best] == all_segmentations(vocabulary, "▁" + body)[:5]
        ids, score, runner_up = two.encode(text)
        assert (score, runner_up) == (best[0][0], best[1][0] if len(best) > 1 else None)
        assert two.decode(ids) == text
    for text in ("", " ", "  a  ", "▁▁x", "😀 é", "x" * 500, "\ufffd"):
        assert two.decode(two.encode(text)[0]) == text
    assert five.encode_n("") == [(0, ())] and two.encode("")[1:] == (0, None)


def test_long_runs_of_one_character_are_searched_depth_first():
    vocabulary = pieces.Pieces.load(pieces.default_model())
    encoder = pieces.Encoder(vocabulary, 2)
    for char in "a=_日":
        text = char * 10_000
        ids, score, runner_up = encoder.encode(text)
        assert encoder.decode(ids) == text
        best = encoder.encode_n(text)
        assert (score, tuple(ids)) == best[0] and runner_up == (best[1][0] if len(best) > 1 else None)


def test_back_pointers_and_search_give_the_same_ids_scores_and_gaps():
    vocabulary = pieces.Pieces.load(pieces.default_model())
    draw = random.Random(12)
    units = {"▁" + "".join(draw.choice("aabetion=_") for _ in range(draw.randint(1, 40))) for _ in range(400)}
    for unit, (ids, score, gap) in vocabulary.solve(sorted(units)).items():
        first, other = vocabulary.n_best(unit, 2)
        assert (tuple(np.frombuffer(ids, "<i4")), score, gap) == (first[1], first[0], first[0] - other[0])


def test_short_words_come_from_the_backward_search_with_both_segmentations(monkeypatch):
    vocabulary = pieces.Pieces.load(pieces.default_model())
    draw = random.Random(8)
    for chars in ("aabetion=_", "the an.ingeré\n日" + pieces.OWN_MARK, "aa", "日本é😀x"):
        units = sorted({"▁" * draw.randint(0, 2) + "".join(draw.choice(chars) for _ in range(draw.randint(1, 40))) for _ in range(150)})
        found = pieces.TwoBest(vocabulary, units)
        ids = [found.ids(0), found.ids(1)]
        for k, unit in enumerate(units):
            got = [(found.totals[r, k], tuple(np.frombuffer(ids[r][k], "<i4"))) for r in (0, 1) if found.paths[r, k] >= 0]
            assert tuple(got) == vocabulary.n_best(unit, 2)
    searched = []

    class Watched(pieces.TwoBest):
        def _backward(self, n):
            searched.append(n)
            return super()._backward(n)

    monkeypatch.setattr(pieces, "TwoBest", Watched)
    encoder = pieces.Encoder(vocabulary, 2)
    assert encoder.decode(encoder.encode("plain words, and 日本é😀")[0]) == "plain words, and 日本é😀"
    assert searched == [4]


def test_encoding_of_odd_tables(odd_documents, no_documents):
    rows = pieces.digest(odd_documents).collect()
    assert len(rows) == 9 and all(r.restored for r in rows)
    assert pieces.digest(no_documents).count() == 0
    best = pieces.segmentations(odd_documents.where("doc_id = 5"), 3).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3] and best[0].score >= best[1].score >= best[2].score
    encoded = pieces.encode(odd_documents, out="quality").select("text", "quality.ids")
    again = pieces.decode(encoded).where(F.coalesce("text", F.lit("")) != F.col("decoded")).count()
    assert again == 0


def test_token_ids_equal_the_tokenizer_and_files_read_back(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    draw = random.Random(4)
    parts = ["a", "don't", " ", "  ", "\n", "\n\n", "\t", "x1", "9", "!", "é", "日本", "\u00a0", "\u3000", "<|endoftext|>", "\x1c", "'s", "\r\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(1500)]
    for text, packed in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    rows = sorted(odd_documents.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for row in rows:
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        want.append((row.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    read = token_files.read_token_files(spark, token_files.write_token_files(odd_documents))
    assert sorted(map(tuple, read.collect()), key=lambda r: r[1]) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(no_documents)).count() == 0


def test_fingerprints_and_edited_texts(spark, odd_documents, no_documents):
    rows = sorted(odd_documents.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in rows]
    want = []
    for k, text in enumerate(texts):
        quarter, following = len(text) // 4, texts[(k + 1) % len(texts)]
        changed = text[: len(text) - quarter] + following[:quarter]
        own, other = fingerprint.simhash(text), fingerprint.simhash(changed)
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((rows[k].doc_id, len(text), sha, own.hex(), other.hex(), fingerprint.likeness(own, other), fingerprint.likeness(own, fingerprint.simhash(following))))
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(map(tuple, fingerprint.edited(odd_documents).collect()), key=key) == sorted(want, key=key)
    assert fingerprint.edited(no_documents).count() == 0 and fingerprint.report(no_documents).count() == 0
    assert fingerprint.report(odd_documents).count() == 9


def test_near_fingerprints_equal_brute_force(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(128) for _ in range(20)]
    values = set()
    for value in base:
        values.add(value)
        for flips in range(1, 6):
            changed = value
            for bit in draw.sample(range(128), flips):
                changed ^= 1 << bit
            values.add(changed)
    hexes = sorted(f"{v:032x}" for v in values)
    want = {
        (a, b, (int(a, 16) ^ int(b, 16)).bit_count())
        for a in hexes for b in hexes if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3
    }
    table = spark.createDataFrame([(h,) for h in hexes + hexes[:3]] + [(None,)], "fingerprint string")
    assert {tuple(r) for r in fingerprint.near_pairs(table).collect()} == want
    around = {r.fingerprint: r.n_near for r in fingerprint.near_counts(table).collect()}
    many = {h: 2 if h in hexes[:3] else 1 for h in hexes}
    for h in hexes:
        assert around[h] == many[h] - 1 + sum(many[b if a == h else a] for a, b, _ in want if h in (a, b))


PAGE = """<body><header><h1>Site</h1></header><div id=menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div>
<div class="cookie-notice">We use cookies, many, of, them, all.</div><div class="content"><h2>Title</h2>
<p>First para, with commas, and a <a href=x>link</a> &amp; more text to be long enough.<p>Second&nbsp;para is, also, long
enough to be counted.<form><p>Mail me, please, now</p></form><script>x="</p>"</script><table><tr><td>cell<td>two</table></div>
<div class="comments"><p>Reader says, this, is, a comment which is long enough.</p></div><footer>foot</footer>"""


def test_main_text():
    want = "Title\nFirst para, with commas, and a link & more text to be long enough.\nSecond para is, also, long enough to be counted.\ncell\ntwo"
    assert html_text.extract(PAGE) == want
    assert html_text.extract("<p>only</p>") == "only" and html_text.extract("plain &lt;") == "plain <"
    for empty in (None, "", "<nav>x</nav>", "<!-- x", "<div class=", "<script>a"):
        assert html_text.extract(empty) == ""


def test_marked_wrappers_around_the_main_text_are_kept():
    long = "A paragraph, with commas, which is long enough to be counted as main text of the page."
    aside = '<div class="sidebar"><p>Aside, aside, aside.</p></div><div class="comments"><article><p>' + 9 * long + "</p></article></div>"
    for around in ('<div class="layout has-sidebar">', '<div id="page" class="page with-header">', "<form method=post>", "<form><div class=no-footer>"):
        for inner in (f"<article><p>{long}</p></article>", f"<main><p>{long}</p></main>", f"<div><p>{long}</p><p>{long}</p></div>"):
            page = f"<body>{around}<nav><a href=1>Menu</a></nav>{inner}{aside}</body>"
            assert set(html_text.extract(page).split("\n")) == {long}
    teaser = f"<aside class=related><article><p>{long[:40]}</p></article></aside>"
    assert html_text.extract(f"<body><article><p>{long}</p></article>{teaser}</body>") == long
    assert html_text.extract(f"<body><div><p>{long}</p></div>{teaser}<div hidden><main><p>{long}x</p></main></div></body>") == long


def test_template_language_and_round_trip(spark):
    template = chat.Template("{% if 1 == 2 %}no{% else %}{{ 'a' + 'b' }}{% endif %}{% for m in messages %}{% if loop.first %}^{% endif %}{{ m['text']|trim|upper }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert template.render([{"text": " x "}, {"text": "y"}])[0] == "ab^X,Y"
    assert chat.fold_body(chat.parse("a{{ 'b' }}{% if false %}c{% endif %}d")) == [("text", "abd")]
    for bad in ("{{ x() }}", "{% for %}", "{% if a %}", "{{ a|none_such }}", "{% endif %}", "{{ 'a' ; }}"):
        try:
            chat.Template(bad)
        except chat.TemplateError:
            continue
        raise AssertionError(bad)
    rows = [
        (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant<|im_sep|>x<||y<"),
        (1, 0, "user", "a <| b"),
        (2, 0, None, None),
        (2, None, "assistant", ""),
        (None, 0, "assistant", "n"),
        (3, 0, "assistant", "t"),
        (3, 0, "assistant", "t"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv_id, row in got.items():
        turns = sorted(
            ((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv_id)
        )
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and row.n_turns == len(turns)
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert all(got[c].formatted_chars == len(formatted[c].formatted) for c in got)
    one = formatted[1]
    assert "".join(chat.unescape(one.formatted[s.start : s.stop]) for s in one.spans) == rows[0][3]
    assert chat.digests(table.limit(0)).count() == 0


def test_language_models(odd_documents, no_documents):
    model = language.train(odd_documents)
    assert model.names == ["de", "en"]
    rows = language.identify(odd_documents, model, out="quality").select("doc_id", "quality.*").collect()
    named = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and named[7].lang == "de" and named[1].lang == "en"
    for undetermined in (2, 3, 5, 6):
        assert (named[undetermined].lang, named[undetermined].score, named[undetermined].accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = language.train(no_documents)
    assert {r.language.lang for r in language.identify(odd_documents, nothing).collect()} == {"und"}


def test_quality_model(spark, odd_documents, no_documents):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows, ratings = [], []
    for k in range(600):
        grade = k % 3
        text = " ".join(draw.choices(words, k=30)) + (" " + f"tox{draw.randint(0, 9)}ic" if grade == 1 else "")
        rows.append((k, text if grade else "JUNK!! " * 20))
        ratings.append((k, grade))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*ratings, (None, 1), (0, 9)], "doc_id bigint, grade int")
    model = quality.train(docs.where("doc_id < 400"), marks, 3)
    assert model.thresholds[0] < model.thresholds[1]
    held = quality.score(docs.where("doc_id >= 400"), model).select("doc_id", "quality.*").collect()
    right = sum((r.tails[1] >= 0.5) == (r.doc_id % 3 == 2) for r in held)
    assert right >= 0.95 * len(held)
    assert all(abs(r.expected - sum(r.tails)) < 1e-9 and r.tails[0] >= r.tails[1] for r in held)
    odd = quality.score(odd_documents, model).select("doc_id", "quality.expected").collect()
    assert len(odd) == 9 and all(r.expected == 0 for r in odd if r.doc_id in (2, 3, 6))
    empty = quality.train(no_documents, marks.limit(0), 3)
    assert quality.score(docs.limit(5), empty).count() == 5


def test_url_rules_and_templates(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = [
        "https://a.Example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "x://b.com/fr/", "x://b.com/de/1",
        "x://com/de/", "x://telecom/de/", "x://b.com", None, "no url", "http://org", "http://h.net/a/b/c/d/e/f#g", "http://h.net//x/",
    ]
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(f"http://bad.net/p/{k}", True) for k in range(60)] + [(f"http://good.net/p/{k}", False) for k in range(60)] + [(None, None)], "url string, bad boolean")
    more = labels.where("url is not null").selectExpr("cast(100 as bigint) page_id", "url", "'t' host")
    rows = url_filter.judge_urls(pages.union(more), labels, rules).collect()
    assert len(rows) == len(urls) + 120
    by_id = {r.page_id: r for r in rows if r.page_id < 100}
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:end].lower(), rest[end:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fit = [(len(r), v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        want = max(fit)[1:] if fit else (None, None)
        assert (by_id[k].host, by_id[k].path, by_id[k].rule) == (host, path, want[1])
        assert by_id[k].verdict == (want[0] or by_id[k].verdict)
    assert {r.verdict for r in rows if r.host == "bad.net"} == {"block"} and {r.verdict for r in rows if r.host == "good.net"} == {"allow"}
    assert len({r.template for r in rows if r.host == "bad.net"}) == 1
    assert url_filter.judge_urls(pages.limit(0), labels.limit(0), rules).count() == 0


def test_template_trees_go_down_to_the_last_segment(spark):
    bad = [f"http://deep.org/2024/05/17/news/bad/p{k}" for k in range(60)]
    good = [f"http://deep.org/2024/05/17/news/good/p{k}" for k in range(180)]
    lone = "http://deep.org/" + "/".join("s" * 70)
    rows = [(k, u) for k, u in enumerate([*bad, *good, lone])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, bad boolean")
    judged = {r.page_id: r for r in url_filter.judge_urls(pages, labels, []).collect()}
    assert len(judged) == 241
    assert {judged[k].verdict for k in range(60)} == {"block"}
    assert {judged[k].verdict for k in range(60, 240)} == {"allow"}
    assert judged[240].template == judged[240].path
