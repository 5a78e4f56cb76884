import hashlib
import re

from lodestead.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    spans = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and luhn(d)) or k == 3 and not 10 <= len(d) <= 15):
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    None, "", "a@b", "x.y+z@ex-am.co.uk.", "a@b.c_d@e.f", "a@b.c.d@e.f", "%@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.0255", "1.2.3.99999999999999999999999", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
    "4111  1111", "+1 (415) 555-1212", "+1 (415) 555-121", "+(1) 2", "+12345678901234567890", "+1-2+3 4567890123", "é日𝄞 a@b.co 𝄞 10.0.0.1", "@@a@b.c@d.e", "+1.2.3.4 5678901", "5500 0000 0000 0004 5500 0000 0000 0004",
    "a" * 50_000 + "@", "a." * 20_000 + "b@" + "c." * 20_000 + "d", "1" * 50_000, "1." * 20_000, "+" + "(" * 50_000, "9-" * 30_000,
]


def test_base_spans(make_docs):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    for r in pii.find_pii(make_docs(*rows, (len(TEXTS), "x a@b.co", None, None), (len(TEXTS), "x a@b.co", None, None))).collect():
        want = brute(TEXTS[r.doc_id] if r.doc_id < len(TEXTS) else "x a@b.co")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want.split(",")) for k in pii.KINDS]
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_odd_and_empty(make_docs, odd_docs):
    out = pii.find_pii(make_docs(*odd_docs)).collect()
    assert len(out) == len(odd_docs) and {r.doc_id: r.n_email for r in out}[6] == 1
    assert pii.find_pii(make_docs((1, "a", None, None)).where("false")).count() == 0


def test_patterns_find_unseen(make_docs):
    """`card` and `tel` stand before seeds again and again; what else stands there is found, `order` numbers are not."""
    seeds = ["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220", "6011111111111117", "3530111333300000"]
    rows = [(i, f"pay by card {s} now", None, None) for i, s in enumerate(seeds)]
    rows += [(20 + i, f"see order {10**15 + 7 * i + (1 if luhn(str(10**15 + 7 * i)) else 0)} there", None, None) for i in range(6)]
    rows += [(40, "pay by card 4111111111111112 now", None, None), (41, "nothing here", None, None)]
    out = {r.doc_id: r for r in pii.find_pii(make_docs(*rows)).collect()}
    assert out[40].spans == "card:12:28" and out[40].n_card == 0 and out[40].n_found == 1
    assert all(out[i].n_found == 0 for i in out if i != 40) and out[41].spans == ""


def test_contexts_on_either_side(make_docs):
    """The word on the right and the words on both sides find what the word on the left alone does not."""
    seeds = ["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220", "6011111111111117", "3530111333300000"]
    rows = [(i, f"w{'abcdef'[i]} {s} visa", None, None) for i, s in enumerate(seeds)]
    rows += [(40, "other 4111111111111112 visa", None, None), (41, "other 4111111111111112 else", None, None)]
    told = []
    out = {r.doc_id: r for r in pii.find_pii(make_docs(*rows), told=told).collect()}
    assert out[40].spans == "card:6:22" and out[41].spans == "" and told[0][0] == 1


def test_base_spans_that_instances_touch(make_docs):
    """A phone number with wide gaps covers several instances; none of them is new, whatever stands before."""
    rows = [(i, f"call {s} now", None, None) for i, s in enumerate(["+1  (415)  5551212", "+1  (415)  5551213", "+1 (415) 5551214", "+1 415 555 1215", "+1 415 555 1216", "+1 415 555 1217"])]
    for r in pii.find_pii(make_docs(*rows, (9, "call a@b.co 10.0.0.1 or 4111111111111111 x", None, None))).collect():
        assert r.n_found == 0 and (r.n_phone == 1 or r.spans == "email:5:11,ip:12:20,card:24:40")


def test_time_is_linear_in_instances(make_docs):
    """A text full of instances, and twice as much of it, against brute force."""
    import time

    took = []
    for many in (40_000, 80_000):
        text = "ab 1234567 cd a@b.co " * many
        docs = make_docs((1, text, None, None))
        began = time.time()
        r = pii.find_pii(docs).first()
        took.append(time.time() - began)
        assert r.n_email == many and r.base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest()
    assert took[1] < 3 * took[0] + 5, took
