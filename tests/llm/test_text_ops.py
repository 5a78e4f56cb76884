import dataclasses
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestead.llm import html_wrapper as H
from lodestead.llm import language_id as L
from lodestead.llm import license_scan, mixing, sharding
from lodestead.llm import sentencepiece_codec as S

# sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 64, 65, 1000, 4099])
def test_permutation(n):
    p = sharding.Permutation(n, 5)
    assert sorted(p.of(i) for i in range(n)) == list(range(n))
    assert all(p.back(p.of(i)) == i for i in range(0, n, 7))


def test_shard(make_docs, odd_docs):
    rows = odd_docs + [(100 + i, f"t{i}", None, None) for i in range(500)]
    out = sharding.shard(make_docs(*rows), 8, 3).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    p = sharding.Permutation(len(rows), 3)
    assert all((p.of(r.row_number) % 8, p.of(r.row_number) // 8) == (r.shard, r.slot) and sharding.row_of(r.shard, r.slot, 8, p) == r.row_number for r in out)
    alike = sharding.shard(make_docs(*[(None, "same", None, None)] * 300, *[(7, f"x{i}", None, None) for i in range(300)]), 8, 3).collect()
    assert sorted(r.row_number for r in alike) == list(range(600)) and {len([r for r in alike if r.shard == k]) for k in range(8)} == {75}
    again = sharding.shard(make_docs(*reversed(rows)).repartition(3), 8, 3).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.shard(make_docs(*rows).where("false")).count() == 0


# mixing


def brute_best(items, budget):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= budget}
    return max(sums)


def test_fit_lengths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 8)))
        counts = rng.integers(1, 6, len(lengths))
        items = [int(x) for x, n in zip(lengths, counts) for _ in range(n)]
        budget = int(rng.integers(0, sum(items) + 1))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == brute_best(items, budget)
    lengths, counts = np.arange(1, 2000), np.full(1999, 50)
    assert int((mixing.fit_lengths(lengths, counts, 12_345_678) * lengths).sum()) == 12_345_678


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45, 2) == [20, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.water_fill([1, 100], [5, 2], 151.5, 2) == [2, 149.5] and mixing.water_fill([], [], 0, 2) == [] and mixing.water_fill([0, 4], [5, 2], 6, 2) == [0, 6]


def test_mix(make_docs):
    rows = [(i, "w " * (i % 17 + 1), None, "abc"[i % 3]) for i in range(6000)] + [(9000, None, None, None), (9001, "", None, None), (9002, "x y", None, None), (9002, "x y", None, None), (9003, "z", None, "\U0001f600")]
    docs = make_docs(*rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= 2 and (r.size or not r.copies) for r in out)
    size, source = {i: len((t or "").split()) for i, t, *_ in rows}, {i: s for i, _, _, s in rows}
    taken, target, total = Counter(), {}, Counter()
    for r in out:
        assert r.size == size[r.doc_id]
        taken[source[r.doc_id]] += r.copies * r.size
        total[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    want = mixing.water_fill([total[s] for s in ("a", "b", "c", "\U0001f600", None)], [5, 2, 1, 5, 2], 1.5 * sum(total.values()), 2)
    assert [target[s] for s in ("a", "b", "c", "\U0001f600", None)] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in ((i, sum(r.copies for r in out if r.doc_id == i)) for i in {r.doc_id for r in out}) if n})


def test_mix_hot_length(make_docs):
    """One (source, length) group larger than a range is cut where the plan says, exactly."""
    docs = make_docs(*[(i, "same words", None, "a" if i < 9000 else "b") for i in range(10000)])
    out = mixing.mix(docs)
    assert out.where("doc_id < 9000").agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == pytest.approx(out.where("doc_id < 9000").first().target, abs=2)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixed_documents_keep_to_their_sources(make_docs):
    """Equal ids and texts in two sources, rows alike that differ in another column: totals do not depend on the order."""
    rows = [(7, "one two three", None, "x")] * 3 + [(7, "one two three", None, "y")] * 5 + [(8, "a b", "en", "x"), (8, "a b", "fr", "x"), (8, "a b", None, "x"), (9, "c", None, "y")]
    results = []
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        docs = make_docs(*order).repartition(4)
        plan = defaultdict(int)
        for r in mixing.mix(docs).join(docs.select("doc_id", "source").distinct().where("doc_id <> 7"), "doc_id", "left").collect():
            plan[r.doc_id] += r.copies
        got = Counter((r.doc_id, r.source, r.lang) for r in mixing.mixed_documents(docs).collect())
        assert all(sum(n for k, n in got.items() if k[0] == i) == plan[i] for i in plan)
        results.append(got)
    assert results[0] == results[1] == results[2]


def test_mix_odd(make_docs, odd_docs):
    assert mixing.mix(make_docs(*odd_docs)).count() == len(odd_docs)


# language ID


def test_language_id(make_docs):
    words = {"en": "the and house with garden", "fr": "le et maison avec jardin", "de": "der und haus mit garten"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang].split(), 30)), lang, None) for i in range(600) for lang in [["en", "fr", "de"][i % 3]]]
    docs = make_docs(*rows)
    out = {r.doc_id: r for r in L.identify_languages(docs).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 and out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang, _ in rows)
    model = L.train(docs)
    unseen = L.Scorer(model)
    assert [unseen.predict(t)[0] for t in ("hausgarten", "maisonette", "housed gardens")] == ["de", "fr", "en"]
    assert [unseen.predict(t) for t in (None, "", "12 ²½ _ !", " ")] == [("und", 0.0)] * 4
    assert unseen.predict("the " * 400_000 + "haus")[0] == "en"


def test_labels_do_not_leak(make_docs):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "x" if i % 2 else "y", None) for i in range(200)]
    flipped = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "z", "s") for i, t, lang, _ in rows]
    a, b = (sorted((r.doc_id, r.lang_pred) for r in L.identify_languages(make_docs(*x)).collect()) for x in (rows, flipped))
    assert a == b


def test_language_odd(make_docs, odd_docs):
    out = L.identify_languages(make_docs(*odd_docs)).collect()
    assert len(out) == len(odd_docs) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 8)} == {"und"}
    nothing = L.identify_languages(make_docs((1, "text", None, None))).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert L.identify_languages(make_docs((1, "a", "en", None)).where("false")).count() == 0
    kept = L.keep_identified(make_docs(*odd_docs, *[(100 + i, "some more words", "en", None) for i in range(20)]))
    assert {1, 2, 3, 8}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == make_docs(*odd_docs).columns


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.MODEL, 2)


TEXTS = ["", "  hi  there\n\nx  ", "a\tb", " ", "日本語 text ☃ 🤖", "aaaa    bbbb", "x" * 5000, "<s> </s> <unk> <0x41>", "a\u0000b", "The quick brown fox. " * 200, "Ünïcödé é", "word " * 100_000]


def test_parity_and_round_trip(codec):
    packed = codec.encode(TEXTS)
    for text, p in zip(TEXTS, packed):
        ids = np.frombuffer(p, np.int32).tolist()
        assert ids == codec.original.encode(text)
        assert codec.decode(ids) == text == codec.tokenizer.decode(ids, skip_special_tokens=False)


def test_unigram_is_rebuilt():
    from tokenizers import Tokenizer

    pieces = [("<unk>", 0.0, S.UNKNOWN), *[(f"<0x{i:02X}>", -20.0, S.BYTE) for i in range(256)], ("▁", -3.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁a", -1.0, 1), ("ab", -2.5, 1), ("▁ab", -1.2, 1)]
    t = S.build(S.Spec(pieces, S.UNIGRAM, True, b"", True, True, True))
    assert isinstance(t, Tokenizer) and t.encode("  ab   a é").tokens == ["▁ab", "▁a", "▁", "<0xC3>", "<0xA9>"] and t.decode(t.encode("ab a é").ids) == "ab a é"


def test_encode_documents(make_docs, odd_docs):
    out = S.token_digests(make_docs(*odd_docs), parity=1).collect()
    assert len(out) == len(odd_docs) and all(r.round_trip and r.checked and not r.original for r in out)
    import sentencepiece

    right = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    by = {i: t or "" for i, t, *_ in odd_docs}
    for r in out:
        ids = right.encode(by[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert S.token_digests(make_docs((1, "a", None, None)).where("false")).count() == 0


def tapped(codec, name):
    """Calls of a method of the codec, as they are made."""
    made, was = [], getattr(codec, name)
    setattr(codec, name, lambda *a, **k: made.append(a) or was(*a, **k))
    return made


def ids_of(codec, texts):
    return [np.frombuffer(p, np.int32).tolist() for p in codec.encode(texts)]


def test_words_that_come_again_stay_in_memory(monkeypatch):
    monkeypatch.setattr(S, "MEMO", 60)
    codec = S.Codec(S.MODEL, 1)
    told = tapped(codec, "_remember")
    for i in range(20):
        text = f"the quick brown fox {' '.join(f'w{i}x{k}' for k in range(20))} the lazy dog"
        assert ids_of(codec, [text]) == [codec.original.encode(text)] and len(codec.memo) <= 60
    times = Counter(w.lstrip(S.MARK) for (new,) in told for w in new)
    assert [times[w] for w in ("the", "quick", "lazy", "dog", "w3x5")] == [1] * 5


def test_new_words_are_encoded_in_runs():
    codec = S.Codec(S.MODEL, 1)
    inputs, was = [], codec.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **how):
            inputs.extend(texts)
            return was(texts, **how)

    codec.tokenizer = Counted()
    text = " ".join(f"word{i}." for i in range(1000))
    assert ids_of(codec, [text]) == [codec.original.encode(text)] and len(inputs) <= 1000 // 16


SPACES = ["a  b", " a", "a ", "a   ", "  ", " ", "", "▁", "▁a", "a▁▁b ", "▁▁", "a \n b", "\n", "a\u0000 b", "\t a  ▁ b", "\u00a0 a\u2003b", "é ☃☃ ☃", "a" * 300]


@pytest.mark.parametrize("memo, run", [(160_000, 64), (4, 2), (1, 1)])
def test_spaces_and_markers_keep_parity(monkeypatch, memo, run):
    monkeypatch.setattr(S, "MEMO", memo)
    monkeypatch.setattr(S, "RUN", run)
    codec = S.Codec(S.MODEL, 1)
    for texts in (SPACES, SPACES[::-1], [a + b for a in SPACES for b in SPACES], [f"{a} x{b}" for a in SPACES for b in SPACES]):
        assert ids_of(codec, texts) == [codec.original.encode(t) for t in texts]


def test_a_wrong_rebuild_is_found_out_in_runs():
    """Merges in the wrong order: each word that they change takes the original's ids, and its texts say so."""
    codec = S.Codec(S.MODEL, 1)
    codec.tokenizer = S.build(dataclasses.replace(codec.spec, pieces=[(p, -score, kind) for p, score, kind in codec.spec.pieces]))
    codec.tokenizer.normalizer = codec.tokenizer.pre_tokenizer = None
    texts = ["a b", "international cooperation", "a cooperation b", "a"]
    packed, own = codec.encode_told(texts)
    assert [np.frombuffer(p, np.int32).tolist() for p in packed] == [codec.original.encode(t) for t in texts] and own == [False, True, True, False]


@pytest.mark.parametrize("kind, more", [("bpe", {}), ("bpe", {"byte_fallback": True}), ("unigram", {"byte_fallback": True})])
def test_other_plain_models(tmp_path, kind, more):
    import io

    import sentencepiece

    made, lines = io.BytesIO(), [f"the cat number {i} sat on mat {i * 7} and the dog barked at rat {i * 13}" for i in range(300)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_writer=made, vocab_size=340, hard_vocab_limit=False, model_type=kind, normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2, **more)
    (tmp_path / "m.model").write_bytes(made.getvalue())
    codec = S.Codec(str(tmp_path / "m.model"), 1)
    texts = [*lines, "the cat", "cats and  dogs zzz", "é ☃ the", "mat "]
    assert codec.plain and codec.by_word and ids_of(codec, texts) == [codec.original.encode(t) for t in texts]


# licences


WRAPPED = [("MIT", license_scan.MIT), ("ISC", license_scan.ISC), ("BSD-2-Clause", license_scan.BSD2), ("BSD-3-Clause", license_scan.BSD3), ("0BSD", license_scan.ZERO_BSD), ("Zlib", license_scan.ZLIB), ("BSL-1.0", license_scan.BOOST), ("Apache-2.0", license_scan.APACHE_HEADER), ("Unlicense", license_scan.UNLICENSE)]


def test_licenses_at_all_widths(make_docs):
    """Whole licences wrapped at 60 to 100 columns, each paragraph on a line, or in one line."""
    import textwrap

    rows, want = [], []
    for name, text in WRAPPED:
        for width in (*range(60, 101), 0, None):
            said = text if width is None else " ".join(text.split()) if not width else "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))
            rows.append((len(rows), "Copyright (c) 2021 The Authors. All rights reserved.\nAll rights reserved.\n\n" + said if len(rows) % 2 else said, None, None))
            want.append(name)
    out = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(*rows)).collect()}
    assert [out[i].text_license for i in range(len(rows))] == want
    assert all(want[i] in out[i].licenses.split(",") for i in out)


def test_one_line_licenses_inside_a_text(make_docs):
    rows = [(i, "before\n" + " ".join(t.split()) + "\nafter", None, None) for i, (_, t) in enumerate(WRAPPED)]
    assert {r.doc_id: r.licenses for r in license_scan.scan_licenses(make_docs(*rows)).collect()} == {i: n for i, (n, _) in enumerate(WRAPPED)}


def test_copyright_lines():
    gone = ["Copyright (c) 2020 Someone", "© Someone", "(C) 1999-2004, me", "# Copyright: 2001 x", "Copyright [yyyy] [name of copyright owner]", "copyright by me", "Copyright Jane Doe", "All rights reserved.", "  ALL RIGHTS RESERVED"]
    kept = ["copyright notice, this list of conditions", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "copyright holder or contributors", "(c) You must retain all notices", "The copyright notice", "Copyright law applies", "copyright " + "2020 word " * 40]
    assert [license_scan.canonical(x) for x in gone] == [""] * len(gone)
    assert all(license_scan.canonical(x) for x in kept)


def test_whole_licences_and_a_callers_own(make_docs):
    from pathlib import Path

    shared = Path("/usr/share/common-licenses")
    files = [(name, shared / f) for name, f in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")) if (shared / f).exists()]
    rows = [(i, f.read_text(), None, None) for i, (_, f) in enumerate(files)] + [(90, "My own Licence\n\nDo   what you like!", None, None), (91, "licence licence licence", None, None)]
    out = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(*rows), more=[("Own", "my own license: do what you like")]).collect()}
    assert [out[i].text_license for i in range(len(files))] == [n for n, _ in files] and out[90].text_license == "Own"
    assert out[91].canonical_sha256 == hashlib.sha256(b"license license license").hexdigest()


def test_licenses(make_docs, odd_docs):
    mit = "The MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + license_scan.MIT.upper().replace(",", " ,")
    rows = [(1, mit, None, None), (2, "text\nreleased under the MIT licence!\nLicensed under CC BY-NC 4.0\nmore", None, None), (3, "This text mentions the MIT License.", None, None), (4, license_scan.APACHE_HEADER.replace("http:", "https:"), None, None), (5, "GNU\n  This work is licensed under the GNU General Public License, version 3.", None, None)]
    out = {r.doc_id: r for r in license_scan.scan_licenses(make_docs(*rows)).collect()}
    assert (out[1].text_license, out[4].text_license, out[3].text_license, out[3].n_lines) == ("MIT", "Apache-2.0", None, 0)
    assert (out[2].text_license, out[2].n_lines, out[2].licenses, out[5].licenses) == (None, 2, "CC-BY-NC-4.0,MIT", "GPL-3.0")
    assert all(r.canonical_sha256 == license_scan.digest(dict((i, t) for i, t, *_ in rows)[r.doc_id]) for r in out.values())
    odd = license_scan.scan_licenses(make_docs(*odd_docs)).collect()
    assert len(odd) == len(odd_docs) and all(r.licenses == "" and r.text_license is None for r in odd)


# HTML wrappers

NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"


def page_of(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{NAV}<div class='ad banner'>Buy</div>{body}<footer>&copy; x</footer></body></html>"


PAGES = [
    (page_of("<article><h1>One &amp; two</h1><p><b>Bold</b>ly\n said<br>so<p>next</article>"), "One & two Boldly said so next"),
    (page_of("<article><h1>Only</h1></article>"), "Only"),
    (page_of("<article><h1>A</h1><p>b</p><div class='share'>tweet</div><aside>c</aside><form><label>d</label></form><ul><li>e<li>f</ul></article><section id='comments'><article class='comment'>g</article></section>"), "A b e f"),
    (page_of("<article><h1>Cut</h1><p>in the mid")[: page_of("<article><h1>Cut</h1><p>in the mid").index("in the mid") + 6], "Cut in the"),
    (page_of("<div class='cookie-notice'>ok</div><main><header>kept</header><p>M</p></main>"), "kept M"),
    (None, ""), ("", ""), ("plain &lt;text&gt;  here", "plain <text> here"), ("<p>a<!-- no --> b</p><p", "a b"),
]


def test_wrapper_and_extraction():
    wrapper = H.infer([p for p, _ in PAGES[:3]])
    assert wrapper["main"][-1] == "article" and "(<li>#TEXT</li>)+" in H.expression(wrapper["items"]) and "(<p>#TEXT</p>)*" in H.expression(wrapper["items"])
    for page, want in PAGES:
        assert H.extract(page, wrapper)[0] == want
    assert all(H.extract(p, wrapper)[1] == 0 for p, _ in PAGES[:3])  # pages of the sample conform


def test_alignment():
    once = H.generalise(H.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert H.expression(once) == "<dl>(<dt>#TEXT</dt><dd>#TEXT</dd>)+</dl>"
    a, b = (H.generalise(H.parse(x)) for x in ("<div><h2>x</h2><p>y</p></div>", "<div><p>y</p><p>z</p><table><tr><td>1</table></div>"))
    both = H.expression(H.align(a, b))
    assert both == "<div>(<h2>#TEXT</h2>)?(<p>#TEXT</p>)+(<table><tr><td>#TEXT</td></tr></table>)?</div>"
    assert H.expression(H.align(H.align(a, b), a)) == both


def test_density_without_article():
    page = "<html><body><div class=menu>" + "<a>x</a>" * 50 + "</div><div id=c><div><p>" + "long text " * 50 + "</p><p>more</p></div></div></body></html>"
    assert H.extract(page, H.infer([page]))[0] == " ".join(("long text " * 50).split()) + " more"


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example/x?q", p, 1, "w") for i, (p, _) in enumerate(PAGES)] + [(50, None, PAGES[0][0], 1, "w"), (50, None, PAGES[0][0], 1, "w")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, wrapper string")
    out = H.main_text(df).collect()
    assert len(out) == len(rows)
    for r in out:
        want = PAGES[r.page_id][1] if r.page_id < 50 else PAGES[0][1]
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id
    assert H.main_text(df.where("false")).count() == 0


def test_long_page_is_linear():
    page = page_of("<article>" + "<div>" * 3000 + "x" + "<p>y" * 20_000 + "</article>")
    assert H.extract(page, H.infer([page]))[0].startswith("x y y")


# cases of the operators above


def brute_predict(counts, text):
    """Language by the definition, from counts(lang -> name -> n) of words and of n-grams by length."""
    words = Counter(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()))
    langs = sorted(counts)
    if not langs or not any(c.isalpha() for w in words for c in w):
        return "und"

    def logs(kind, name, lang):
        names = {x for k in langs for x in counts[k][kind]}
        return math.log(counts[lang][kind].get(name, 0) + 0.5) - math.log(sum(counts[lang][kind].values()) + 0.5 * len(names) + 1)

    score = dict.fromkeys(langs, 0.0)
    for w, n in words.items():
        if any(w in counts[k][0] for k in langs):
            for k in langs:
                score[k] += n * logs(0, w, k)
            continue
        marked = f"\x02{w}\x03"
        for size in L.GRAMS:
            hits = [g for g in (marked[i : i + size] for i in range(len(marked) - size + 1)) if any(g in counts[k][size] for k in langs)]
            if hits:
                for k in langs:
                    score[k] += n * sum(logs(size, g, k) for g in hits) / len(hits)
                break
    return max(langs, key=lambda k: (score[k], [-ord(c) for c in k]))


def test_prediction_against_brute_force(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    docs = spark.createDataFrame(rows)
    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            mine = counts.setdefault(r.lang, {k: Counter() for k in (0, *L.GRAMS)})
            mine[0].update(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
    for mine in counts.values():
        for w, n in mine[0].items():
            m = f"\x02{w}\x03"
            for size in L.GRAMS:
                for i in range(len(m) - size + 1):
                    mine[size][m[i : i + size]] += n
    got = {r.doc_id: r.lang_pred for r in L.identify_languages(docs).collect()}
    assert got == {r.doc_id: brute_predict(counts, r.text) for r in rows}
    model = L.train(docs)
    laid = L.Scorer(model)
    monkeypatch.setattr(L, "CELLS", 0)
    sparse = L.Scorer(model)
    assert laid.laid and not sparse.laid
    for r in rows:
        (a, x), (b, y) = laid.predict(r.text), sparse.predict(r.text)
        assert a == b and x == pytest.approx(y)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and len(out) > 100


def test_text_without_spaces(make_docs):
    """A long run counts with all its letters; training takes it whole, too."""
    rng = np.random.default_rng(3)
    said = ["".join(rng.choice(list(letters), 40_000)) for letters in ("abcdefg", "mnopqrs")]
    rows = [(i, said[i % 2], "xy"[i % 2], None) for i in range(12)]
    model = L.train(make_docs(*rows))
    assert model.grams.keys() >= {said[0][30_000:30_004], said[1][-4:], said[0][-3:] + "\x03", "\x02" + said[1][:3]}
    assert L.Scorer(model).predict("m" * 70 + said[0][100:5000])[0] == "x"
    assert sum(len(p) for p in L.pieces("a" * 3_000_000)) == 3_000_000 and len(list(L.pieces("a" * 3_000_000))) == 1


def test_many_languages_keep_the_model_small():
    name = lambda k, i: chr(0x4E00 + k) + chr(0x5E00 + i)
    words = L.pd.DataFrame([(f"l{k}", name(k, i), 3) for k in range(200) for i in range(100)], columns=["lang", "name", "n"])
    model = L.build(words, words.iloc[:0])
    assert len(model.above) == 20_000 and L.Scorer(model).predict(f"{name(7, 1)} {name(7, 2)}")[0] == "l7"


def test_small_tables_keep_their_texts(make_docs):
    rows = make_docs((1, "one two", None, None), (2, "12", None, None), (3, None, "en", None))
    assert [r.doc_id for r in L.keep_identified(rows).collect()] == [1]
    once = make_docs((1, "uno due", "it", None), (4, "one two", "en", None), (5, "two one", None, None))
    assert {r.doc_id: r.lang_pred for r in L.identify_languages(once).collect()} == {1: "it", 4: "en", 5: "en"}
