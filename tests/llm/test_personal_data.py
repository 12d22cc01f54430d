"""Personal data in hand-made lines that the training sentences do not make, and time on number tables."""

import random
import time

import pytest

from panelwise.llm import pii

# what stands in a line, and the spans to find in it (base spans included)
LINES = [
    ("2021-03-04 12:30:45 INFO started worker 17 on port 8080", []),
    ("[04/Mar/2021:12:30:45 +0100] GET /index.html 200 51234", []),
    ("04.03.2021 12:30 Uhr, Sitzung 2021/22", []),
    ("From 1914-1918 and 1939-1945 there was war.", []),
    ("ISBN 978-3-16-148410-0, 2nd edition", []),
    ("siehe 3-16-148410-X und 0-306-40615-2", []),
    ("version 2021.03.04.12 of build 1.2.3.4567", []),
    ("release 10.15.7-rc1, kernel 5.4.0-42-generic", []),
    ("1.234.567,89 EUR and 12 345 678 people", []),
    ("lat 52.520008 lon 13.404954", []),
    ("Table 3: 12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60 63", []),
    ("row 1001 1002 1003 1004 1005 1006 1007 1008 1009 1010 1011", []),
    ("pp. 123-145, vol. 12, 2003", []),
    ("see sections 3.1.2.7 to 3.1.2.19 for 300.1.2.3", ["3.1.2.7", "3.1.2.19"]),
    ("§ 12 Abs. 3 Nr. 4, BGBl. 2019 I 1234", []),
    ("order 4711-0815 shipped", []),
    ("call me at 555-123-4567 tomorrow", ["555-123-4567"]),
    ("Tel. 0171-1234567 oder Fax 030/1234567", ["0171-1234567", "030/1234567"]),
    ("tel: 030 1234567", ["030 1234567"]),
    ("Telefon (089) 7654321 abends", ["(089) 7654321"]),
    ("appelez le 01 23 45 67 89 demain", ["01 23 45 67 89"]),
    ("llame al 912 345 678 por la tarde", ["912 345 678"]),
    ("my number is (555) 123-4567.", ["(555) 123-4567"]),
    ("intl +49 30 1234567 works", ["+49 30 1234567"]),
    ("0049 30 1234567 too", ["0049 30 1234567"]),
    ("write to jo.doe (at) example (dot) org please", ["jo.doe (at) example (dot) org"]),
    ("max [at] mail [dot] example [dot] com", ["max [at] mail [dot] example [dot] com"]),
    ("server 10[.]0[.]0[.]1 is down", ["10[.]0[.]0[.]1"]),
    ("pay with 4111.1111.1111.1111 now", ["4111.1111.1111.1111"]),
    ("card 4111/1111/1111/1111 x", ["4111/1111/1111/1111"]),
    ("a 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 b", ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]),
    ("look at (at) the thing, (dot) or not", []),
]


@pytest.fixture(scope="module")
def weights():
    return dict(pii.train())


def found(weights, text):
    base, added = pii.find(text, weights)
    return [text[a:b] for _, a, b in sorted(base + added, key=lambda s: s[1])]


@pytest.mark.parametrize("text, want", LINES)
def test_lines(weights, text, want):
    assert found(weights, text) == want


def test_precision_and_recall_on_lines_put_together(weights):
    r = random.Random(12)
    right = wrong = missed = 0
    for _ in range(300):
        chosen = [r.choice(LINES) for _ in range(r.randint(2, 6))]
        text, want = r.choice(["\n", " und ", "; "]).join(t for t, _ in chosen), [w for _, ws in chosen for w in ws]
        got = found(weights, text)
        hits = sum(min(got.count(w), want.count(w)) for w in set(want))
        right, wrong, missed = right + hits, wrong + len(got) - hits, missed + len(want) - hits
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


def test_logs_and_random_tables_have_no_phones(weights):
    r = random.Random(5)
    log = "\n".join(f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d} ok" for _ in range(1000))
    table = "\n".join(" ".join(str(r.randint(0, 99999)) for _ in range(30)) for _ in range(300))
    assert found(weights, log) == [] and found(weights, table) == []


def test_time_is_linear_in_number_texts(weights):
    r = random.Random(1)
    numbers = " ".join(str(r.randint(0, 999)) for _ in range(250_000))
    for text in ("1 " * 500_000, numbers, "5551234567 " * 90_000, "1 " * 18 + "x ", "a(at)b.c" * 125_000, "1.1." * 250_000, "((1" * 300_000, "1-" * 500_000, "x (at) " + "a.b" * 300_000, "1 1 1 1 1 1 1 1 x " * 50_000):
        begun = time.perf_counter()
        pii.find(text, weights)
        assert time.perf_counter() - begun < 12


def every_part(text):
    """All cards and phones by shape among the parts of the runs, by trying every pair of units."""
    out = set()
    for run in pii._NUMBERS.finditer(text):
        units = [m.span() for m in pii._UNIT.finditer(text, *run.span())]
        for i in range(len(units)):
            for j in range(i, len(units)):
                part = text[units[i][0] : units[j][1]]
                y = units[j][1] - len(part) + len(part.rstrip(" ()./-"))
                x = units[i][0] + len(part) - len(part.lstrip(" )./-"))
                if 7 <= sum(c.isdigit() for c in text[x:y]) <= 20:
                    first = x + (text[x] == "(")
                    out |= {(first, y, 2)} if pii._CARD_SHAPE.fullmatch(text, first, y) else set()
                    out |= {(x, y, 3)} if pii._PHONE_SHAPE.fullmatch(text, x, y) else set()
    return out


def test_long_runs_lose_no_part(weights):
    """Runs of more than 8 and of more than 19 units; what is passed over when looking for spans is never chosen."""
    r = random.Random(3)
    parts = ["1", "12", "345", "6789", "0171", "4111", "1234567", "(089)", "-", "2021"]
    hopeful = pii.Hopeful(weights)
    for n in [9, 12, 20, 40] * 15:
        text = "x " + " ".join(r.choice(parts) for _ in range(n)) + r.choice(["", " y"])
        clusters = list(pii.candidates(text, []))
        assert {c[:3] for cluster in clusters for c in cluster if c[2] in (2, 3)} == every_part(text)
        whole = [s for cluster in clusters for s in pii.decode(weights, text, cluster)]
        assert [s for cluster in pii.candidates(text, [], hopeful) for s in pii.decode(weights, text, cluster)] == whole


def test_card_and_phone_behind_a_long_table(weights):
    table = "12 15 18 21 24 27 30 33 36 39 42 45 "
    for number in ("4111  1111  1111  1111", "(089) 7654321"):
        assert number in found(weights, table + number)


def test_spans_do_not_overlap(weights):
    r = random.Random(8)
    parts = ["12", "345", "6789", "0171", " ", "  ", "-", ".", "(", ")", "/", "+", "(at)", " [dot] ", "ab", "@", "[.]", "x y", "4111", "2021"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        base, added = pii.find(text, weights)
        added.sort(key=lambda s: s[1])
        assert all(a[2] <= b[1] for a, b in zip(added, added[1:])), text
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base), text
        assert all(text[a] not in " -./)" and text[b - 1] not in " -./(" for k, a, b in added if k), text
