"""Operators on single texts against brute force, round trips and hand-made cases."""

from __future__ import annotations

import dataclasses
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from tubula.llm import htmltext, langid, lm, media, pieces, tokencounts, toxicity
from tubula.llm.common import split_words

ODD = ["", " ", "a", "a  b ", "\n", "x" * 5000, "é 日本語 🙂", "<s> id</s>", "tab\tnew\x0bline", "a\x00b", "▁▁ ab"]


def test_words():
    flat, at = split_words(pa.array([*ODD, None]))
    want = [t.encode().lower().split() for t in [*ODD, ""]]
    assert [flat.cast(pa.binary()).to_pylist()[a:b] for a, b in zip(at[:-1], at[1:])] == want


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(0)
    start, step, emit = (x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 5))))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]
    flat, at = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = lm.forward(flat, at, start, step, emit)
    for s, g in zip(seqs, got):
        paths = np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T
        total = sum(start[p[0]] * emit[p[0], s[0]] * np.prod([step[p[i - 1], p[i]] * emit[p[i], s[i]] for i in range(1, len(s))]) for p in paths)
        assert g == pytest.approx(np.log(total))
    first, trans, out, (before,) = np.split(lm.expected_counts(flat, at, start, step, emit), [3, 12, 27])
    assert before == pytest.approx(got.sum(), rel=1e-5)
    assert first.sum() == pytest.approx(4) and trans.sum() == pytest.approx(len(flat) - 4) and out.sum() == pytest.approx(len(flat))
    new = first / first.sum(), trans.reshape(3, 3) / trans.reshape(3, 3).sum(1, keepdims=True), out.reshape(3, 5) / out.reshape(3, 5).sum(1, keepdims=True)
    assert lm.forward(flat, at, *new).sum() > before


def test_png_round_trip_filters_and_damage():
    rng = np.random.default_rng(1)
    for payload in (bytes(64), rng.integers(0, 256, 640, dtype=np.uint8).tobytes(), b"some text " * 64):
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        for at in (0, 20, len(png) // 2, len(png) - 2):
            with pytest.raises(ValueError):
                media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    want = rng.integers(0, 256, (5, 8), dtype=np.uint8)
    kinds, rows = np.array([0, 1, 2, 3, 4], np.uint8), np.zeros_like(want)
    for r in range(5):
        for c in range(8):
            left, up = int(want[r, c - 1]) if c else 0, int(want[r - 1, c]) if r else 0
            corner = int(want[r - 1, c - 1]) if r and c else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            rows[r, c] = (int(want[r, c]) - [0, left, up, (left + up) // 2, near][kinds[r]]) % 256
    assert (media.unfilter(kinds, rows) == want).all()


def test_similar_pictures_have_close_hashes():
    rng = np.random.default_rng(2)
    a = np.kron(rng.integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    far = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    assert far(media.picture_hash(a), media.picture_hash(b)) < 12


def _varint(v):
    out = b""
    while True:
        out += bytes([v & 127 | (128 if v > 127 else 0)])
        v >>= 7
        if not v:
            return out


def _field(n, body):
    return bytes([n << 3 | 2]) + _varint(len(body)) + body


def _proto(pieces_, kind, extra=0, dummy=1):
    """A model file: pieces (text, score, kind), its kind, and whether extra spaces go."""
    out = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces_)
    trainer = b"\x18" + bytes([kind]) + _varint(35 << 3) + b"\x01"
    return out + _field(2, trainer) + _field(3, bytes([0x18, dummy, 0x20, extra, 0x28, 1]))


def _given():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def _encoded(data, texts):
    ids, at = pieces.encode_texts(pieces._tools(data), pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


UNIGRAM = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
UNIGRAM += [(p, s, 1) for p, s in (("▁", -2.0), ("▁he", -3.0), ("llo", -3.5), ("l", -4.0), ("o", -4.1), ("▁hello", -5.0), ("h", -4.2), ("e", -4.3), ("▁wor", -4.6), ("ld", -4.4), ("w", -5.1), ("r", -5.2), ("d", -5.3))]
SPACED = ["\nhello", "hello\t", "\u00a0hello", "hello\u00a0", "  he  llo ", " ", "   ", "hello", " hello", "hello  world", "é 日本語 🙂  ", "", "he▁llo", "hello▁", "wor ld o"]


@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("extra", [0, 1])
def test_models_agree_with_the_reference_library(extra, dummy):
    for data in (_proto(UNIGRAM, 1, extra, dummy), _proto(pieces.parse_model(_given()).pieces, 2, extra, dummy)):
        ref = sentencepiece.SentencePieceProcessor()
        ref.LoadFromSerializedProto(data)
        assert pieces.parse_model(data).byte_fallback and pieces.parse_model(data).remove_extra == bool(extra)
        assert _encoded(data, SPACED) == ref.encode(SPACED)
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(SPACED)), pa.int64()), "text": pa.array(SPACED)})
        rows = next(pieces._report(data)(iter([batch]))).to_pylist()
        assert all(r["round_trip"] for r in rows), [t for t, r in zip(SPACED, rows) if not r["round_trip"]]


def test_pieces_of_odd_texts_agree_and_round_trip():
    data = _given()
    tools = pieces._tools(data)
    for t, ids in zip(ODD, _encoded(data, ODD), strict=True):
        assert ids == tools.reference.encode(t)
        back = tools.tokenizer.decode(ids, skip_special_tokens=False)
        assert back == t.replace("▁", " ") == pieces.spell(tools, np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py().decode()
    with pytest.raises(ValueError):
        pieces.parse_model(data[: len(data) // 2])


def test_every_text_is_compared_with_the_reference_library(monkeypatch):
    data = _given()
    texts = [*ODD, None, *(f"number {k} here" for k in range(100))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    good = next(pieces._report(data)(iter([batch])))
    assert all(good.column("parity").to_pylist()) and all(good.column("round_trip").to_pylist())
    true = pieces._tools(data)

    class Other:
        def __init__(self, word):
            self.word = word

        def encode(self, t):
            return [[*ids, 5] if self.word in x else ids for x, ids in zip(t, true.reference.encode(t))]

    for word in ("77", "日本語", "  b"):  # words of a plain text, and of a text that is encoded whole
        fresh = dataclasses.replace(true, reference=Other(word), slots={}, ids=np.zeros(0, np.int32), ends=np.zeros(1, np.int64))
        monkeypatch.setattr(pieces, "_tools", lambda _, f=fresh: f)
        with pytest.raises(ValueError, match="differ"):
            list(pieces._steps(data, iter([batch])))


def test_a_full_memory_of_words_starts_anew(monkeypatch):
    data = _given()
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    ref = pieces._tools(data).reference
    for k in range(3):
        texts = [f"word{i} again{i % 7} {k}" for i in range(40)]
        assert _encoded(data, texts) == ref.encode(texts)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_tokens_are_attributed_like_brute_force(rule):
    rng = random.Random(4)
    for _ in range(50):
        ends = np.cumsum([rng.randrange(1, 5) for _ in range(12)])
        n = int(ends[-1])
        borders = np.array(sorted({0, n, *rng.sample(range(1, n), 5)}))
        got, _ = tokencounts.attribute(ends, borders, rule)
        want = np.zeros(len(borders) - 1)
        for a, b in zip([0, *ends[:-1]], ends):
            held = [max(0, min(b, y) - max(a, x)) for x, y in zip(borders[:-1], borders[1:])]
            if rule == "split":
                want += np.array(held) / (b - a)
            else:
                want[int(np.argmax(np.array(held) > 0)) if rule == "start" else int(np.argmax(held))] += 1
        assert got == pytest.approx(want) and got.sum() == pytest.approx(12)
    assert tokencounts.attribute(np.zeros(0, np.int64), np.array([0, 0]), rule)[0].tolist() == [0]


def test_html():
    page = '<html><head><title>T</title><script>x("</p>")</script></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a href=1>A</a></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bold\n  word.<br><p>Two&#33;<div class="ad">Buy</div></article><div id="comments"><p>Reader words, many of them, more than the text has, on and on.</p></div><footer>c</footer></body></html>'
    assert htmltext.main_text(page) == "Head & tail\nOne bold word.\nTwo!"
    assert [htmltext.main_text(t) for t in (None, "", "plain", "<p>only")] == ["", "", "plain", "only"]
    assert htmltext.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_long_runs_of_white_space_are_encoded_as_a_whole(monkeypatch):
    with open(tokencounts.VOCABULARY, "rb") as f:
        encoding, _ = tokencounts._encoding(f.read())
    for t in ("\n" * 2_000_000, "a" + " " * 2_000_000 + "b", "x" * 1_000_000):
        assert encoding.decode(tokencounts.encode(encoding, t).tolist()) == t
    rng = random.Random(3)
    monkeypatch.setattr(tokencounts, "_RUNS", re.compile(tokencounts._RUNS.pattern.replace(str(tokencounts.LONG_RUN), "4")))
    for _ in range(300):
        t = "".join(rng.choice([" ", "\n", "\u2003", "\xa0", "    ", "a", "é", "7", ".", "'s"]) for _ in range(rng.randrange(40)))
        assert tokencounts.encode(encoding, t).tolist() == encoding.encode(t, disallowed_special=()), repr(t)


PROSE = "Words of an article that goes on for quite a while, sentence after sentence, so that it is dense. "
LINKS = "<div>" + "".join(f"<a href={i}>Link number {i}</a> " for i in range(30)) + "</div>"


def test_densities_equal_brute_force():
    root = htmltext.parse("<body><div><p>alpha beta</p><p>gamma <a>delta</a></p></div><ul><li><a>one</a><li><a>two</a></ul>tail</body>")
    figures, weights = htmltext.measure(root, named=False)
    assert weights == {}

    def brute(node):  # characters, tags, link characters and link tags below a node
        own = [0, 0, 0, 0]
        for kid in node.kids:
            if isinstance(kid, str):
                own[0] += len(" ".join(kid.split()))
            else:
                c, t, lc, lt = brute(kid)
                own = [own[0] + c, own[1] + t + 1, own[2] + lc, own[3] + lt]
        return [own[0], own[1], own[0], own[1] + 1] if node.tag == "a" else own

    page = brute(root)
    for node, f in figures.items():
        c, t, lc, lt = brute(node)
        assert [f.chars, f.tags, f.link_chars, f.link_tags] == [c, t, lc, lt]
        base = np.log(c / max(1, c - lc) * lc + page[2] / page[0] * c + np.e)
        want = c / max(1, t) * np.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / base
        assert f.density == pytest.approx(want) and f.total == pytest.approx(sum(figures[k].density for k in node.kids if not isinstance(k, str)))


def test_density_finds_the_article_without_names():
    page = f"<html><body>{LINKS}<div><div><h2>Title</h2><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 2}</p></div><div><p>{PROSE * 2}</p></div></div><div>Some site, all rights</div></body></html>"
    got = htmltext.main_text(page)
    assert got.split("\n")[0] == "Title" and got.split("\n")[2] == "Short." and got.count("\n") == 4
    assert "\n".join(htmltext.blocks(htmltext.parse(page))) != got  # the page as a whole isn't its main text


def test_links_and_density_override_names():
    page = f"<body><article><h1>T</h1><p>{PROSE * 2}<p class='social policy'>{PROSE * 2}policy<section id='related-work'><h2>Work</h2><p>{PROSE}other</section>{LINKS}<div class=ad>{PROSE * 5}</div><p>{PROSE}end</article><section id=comments>{f'<p>{PROSE * 9}reader' * 5}</section></body>"
    got = htmltext.main_text(page)
    assert "policy" in got and "other" in got and got.endswith("end") and "Link" not in got and "reader" not in got and got.count("\n") == 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id='cookie-banner'><p>{'We use cookies here. ' * 30}</p></div><article><h1>T</h1><p>{PROSE}</article>", ["T", PROSE.strip()]),
        (f"<div class='page has-sidebar'><div class=content><h1>T</h1><p>{PROSE}</p></div><div class=sidebar><p>{PROSE * 3}</p></div></div>", ["T", PROSE.strip()]),
        (f"<article><h1>T</h1><p>{PROSE}</p><p>See <a href=1>this</a>, <a href=2>that</a>, <a href=3>those</a>.</p></article>", ["T", PROSE.strip(), "See this, that, those."]),
        (f"<article><h1>T</h1><p>{PROSE}</p><ol>{'<li><a href=1>A paper</a>, 2001' * 5}</ol></article>", ["T", PROSE.strip(), *["A paper, 2001"] * 5]),
        (f"<table><tr><td><a href=1>a</a><br><a href=2>b</a><br><a href=3>c</a><td><h1>T</h1><p>{PROSE}</p></table>", ["T", PROSE.strip()]),
        (f"{LINKS}<article><h2>A</h2><p>{PROSE}</p></article><article><h2>B</h2><p>{PROSE}</p></article>", ["A", PROSE.strip(), "B", PROSE.strip()]),
        (f"<main><h1>T</h1><p>{PROSE}</p><aside><p>{PROSE * 3}</p></aside><form><label>Mail</label><input></form><p>end</p></main>", ["T", PROSE.strip(), "end"]),
    ],
)
def test_pages_of_many_kinds(page, want):
    assert htmltext.main_text(f"<html><body>{page}</body></html>").split("\n") == want


#: Parts between two long paragraphs of an article, named by id or class: those that stay, and those that go.
STAY = ["<h2 id=menu>#</h2>", "<h2 id=comments-on-the-text>#</h2>", "<h2 id=related-work>#</h2>", "<h3 id=share-prices>#</h3>", "<h2 class=menu>#</h2>", f"<section id=navigation><h2>#</h2><p>{PROSE * 2}</p></section>", f"<blockquote class=promo-quote><p># {PROSE * 2}</p></blockquote>", f"<div class=image-overlay><p># {PROSE * 2}</p></div>", f"<section id=social><p># {PROSE * 2}</p></section>", "<figure><img><figcaption>#</figcaption></figure>", f"<details><summary>#</summary><p>{PROSE}</p></details>", "<p>#</p>"]
GO = ["<div class=ad>#</div>", f"<div class=ad-box><p># {PROSE}</p></div>", "<div id=newsletter><p>#</p><button>Go</button></div>", f"<section id=comments><p># {PROSE}</p></section>", f"<div class=comments><div class=comment><p># {PROSE}</p></div></div>", "<aside>#</aside>", "<div class=cookie-banner># <button>ok</button></div>", "<nav>#</nav>", "<div class=related-links><a>#</a><a>two</a><a>three</a></div>", "<div id=menu><a>#</a><a>b</a></div>", "<div class=promo-quote><a># more</a></div>"]


@pytest.mark.parametrize(("part", "stays"), [*((p, True) for p in STAY), *((p, False) for p in GO)])
def test_names_alone_condemn_no_text(part, stays):
    page = f"<html><body><nav><a>x</a></nav><article><h1>T</h1><p>{PROSE * 3}</p>{part}<p>{PROSE * 3}</p></article><footer>c</footer></body></html>"
    got = htmltext.main_text(page)
    assert ("#" in got) == stays and got.count(PROSE.strip()) >= 2 and got.startswith("T\n")


def test_pages_of_any_depth_and_size():
    deep = "<div>" * 3000 + f"<nav><a href=1>menu</a></nav><p>{PROSE * 3}</p>" + "</div>" * 3000
    assert htmltext.main_text(deep) == (PROSE * 3).strip()
    long = "<body>" + f"<div><p>{PROSE}</p></div>" * 5000
    assert htmltext.main_text(long).count("\n") == 4999


def test_given_pages_mostly_need_no_names():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    named, bare = [htmltext.main_text(h) for h in pages], [htmltext.main_text(h, named=False) for h in pages]
    article = lambda h: "\n".join(htmltext.blocks(next(k for k in htmltext._order(htmltext.parse(h)) if k.tag == "article")))
    assert named == [article(h) for h in pages]
    assert sum(a == b for a, b in zip(named, bare)) >= 0.95 * len(pages)


def test_languages():
    profiles = {"a": langid.ranked(langid.grams(langid.letters("the cat and the dog and the hen " * 9))), "b": langid.ranked(langid.grams(langid.letters("der hund und die katze und das huhn " * 9)))}
    f = langid.classifier(profiles)
    assert f("the dog")[0] == "a" and f("und der Hund")[0] == "b"
    assert [f(t) for t in (None, "", "12 ??")] == [("und", 0.0)] * 3 and langid.classifier({})("x") == ("und", 0.0)


def test_kernel_table_equals_brute_force():
    words = ["idiot", "idxiot", "clown", "i", "aaaa"]
    for w, x in zip(words, toxicity.features(words)):
        codes, _ = toxicity.encode_words([w])
        want = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN + 1)):
                    c = int(codes[i] << 12 | codes[j] << 6 | codes[k])
                    want[c] = want.get(c, 0) + toxicity.DECAY ** (k - i)
        norm = sum(v * v for v in want.values()) ** 0.5
        assert x == pytest.approx({c: v / norm for c, v in want.items()})
    x = toxicity.features(words)
    table = np.zeros(toxicity.SIZE)
    for c, v in x[0].items():
        table[c] = v
    own = toxicity.word_margins(words, toxicity.Model(table, -0.2), -1.0)
    assert own == pytest.approx(np.maximum(-1, toxicity.kernel(x, x[:1])[:, 0] - 0.2))


def test_text_scores_equal_sums_of_word_kernels():
    texts = ["idiot you idiot", "a clown sat, an idxiot too", "nothing here", "", None, "clownidiotclown" * 4]
    marks = toxicity.features(["idiot", "clown"])
    root = np.array([[1.0, 0.5], [-0.25, 2.0]])
    weights = np.array([0.7, 0.9, 0.3, 0.1, -0.2, 0.05, 0.4, -0.1, 0.2, -1.0])
    model = toxicity.Model(toxicity._table(marks, np.array([1.0, 1.0])), -0.5, toxicity._table(marks, root @ weights[:2]), weights[2:], np.array([1.3, 0.2]))
    got, best = toxicity.text_scores(pa.array(texts), model)
    for text, score, top in zip(texts, got, best):
        words = [w.strip(",") for w in (text or "").split()]
        screened = []
        for w in words:
            pieces = toxicity._pieces(w)
            own = [max(toxicity.FLOOR, float(toxicity.kernel([x], marks).sum()) - 0.5) for x in toxicity.features(pieces)]
            screened.append((max(own), pieces[own.index(max(own))]))
        margins = [m for m, _ in screened]
        want = [max(margins, default=toxicity.FLOOR)]
        for level in toxicity.LEVELS:
            total = sum(max(0, m - level) for m in margins)
            want += [np.log(total + 0.1), np.log((total + 0.1) / (len(words) + 10))]
        phi = toxicity.kernel(toxicity.features(sorted({p for m, p in screened if m >= toxicity.SCREEN})), marks) @ root
        margin = float(phi.sum(0) @ weights[:2] + np.array([*want, 1.0]) @ weights[2:])
        assert top == pytest.approx(want[0]) and score == pytest.approx(1 / (1 + np.exp(-1.3 * margin - 0.2))), text


def test_margin_svm_is_at_its_minimum():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(80, 3)), np.ones((80, 1))], 1)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0.2, 1.0, -1.0)
    ridge = np.array([1.0, 1.0, 1.0, 1e-4])
    loss = lambda w: (np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (ridge * w * w).sum()
    w = toxicity.fit_margin(x, y)
    assert all(loss(w) <= loss(w + 0.01 * step) for step in (*np.eye(4), *-np.eye(4)))


def test_instances_join_single_letters():
    code, at, names = toxicity.instances(pa.array(["you i.d.i.o.t", "an i d i o t here", ""]))
    own = [[names[c] for c in code[a:b]] for a, b in zip(at[:-1], at[1:])]
    assert own[0][-1] == "idiot" and "idiot" in own[1] and own[2] == []
    assert zlib.crc32(b"0") % 5 in range(5)


def test_spaced_words_in_long_runs_stay_whole():
    for before in range(40):
        _, _, names = toxicity.instances(pa.array([" ".join("a" * before + "idiot" + "b" * 30)]))
        assert any("idiot" in p for n in names for p in toxicity._pieces(n)), before
