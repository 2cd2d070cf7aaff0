"""Random-looking strings: recall for keys of each form, names left alone, and the battery in plain Python."""

import base64
import collections
import math
import random
import re
import string

from linetrace.llm import secret_scan as S

ANY = string.ascii_letters + string.digits
NAMES = (
    "CamelCaseIdentifierNumber HttpServletRequestWrapperFactoryBean2 vaccination2021campaign ISBN9783161484100EDITION getElementsByTagNameAndClassName "
    "AbstractSingletonProxyFactoryBean setRequestHeaderValueForContentType https/www/example/com/index/Page/About-Us_2020 usr/local/lib/python3/site-packages/Numpy-core_2"
).split()


def planted(rng, each):
    drawn = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    plain = lambda: base64.b64encode(rng.randbytes(32)).decode()
    url = lambda: base64.urlsafe_b64encode(rng.randbytes(32)).decode()
    forms = {
        "alone": lambda: "see " + plain(),
        "after a name": lambda: "AUTH=" + plain(),
        "in an address": lambda: f"https://a.example/x?sig={plain()}&b=1",
        "URL-safe after a name": lambda: "KEY=" + url(),
        "URL-safe in a path": lambda: "keys_dir/" + url().rstrip("="),
        "after a dash": lambda: "id-" + plain(),
        "32 characters": lambda: "k " + drawn(ANY, 32),
        "40 letters": lambda: "k " + drawn(string.ascii_letters, 40),
        "40 of hex": lambda: "k " + drawn("0123456789ABCDEF", 40),
    }
    return [(form, make()) for form, make in forms.items() for _ in range(each)]


def test_recall_by_form(spark):
    rng = random.Random(5)
    rows = planted(rng, 60) + [("name", f"the {rng.choice(NAMES)}{rng.choice(['', 'Of', '/', '_'])}{rng.choice(NAMES)} says") for _ in range(400)]
    found = S.scan(spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")).collect()
    hits = collections.Counter(rows[r.doc_id][0] for r in found if "random" in r.spans)
    assert hits.pop("name", 0) <= 4
    # 32 characters alone are near what the battery can tell from names: 51 to 59 of 60, by the names beside them.
    assert all(hits[form] >= (48 if form == "32 characters" else 54) for form, _ in rows if form != "name"), hits


def below(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def battery(text):
    """(uniform, step) of a candidate by the definitions, or None where no encoding fits."""
    for pattern, alphabet, ic, ic3, said in S.ENCODINGS:
        if re.search(pattern, text):
            break
    else:
        return None
    s = text.rstrip("=")
    n, size = len(s), len(alphabet)
    if n < 20:
        return None
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c
    kinds = collections.Counter("0" if c in "+/-_" else kind(c) for c in alphabet)
    even = 1 - sum(k * k for k in kinds.values()) / size**2
    classes = ["0" if c in "+/-_" else kind(c) for c in s]
    turns = sum(a != b for a, b in zip(classes, classes[1:]))
    v = [alphabet.index(c) for c in s]
    mean = sum(v) / n
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / max(sum((a - mean) ** 2 for a in v), 1e-9)
    z = math.atanh(max(-0.999, min(0.999, r + 1 / n)))
    pairs, most = sum(k * (k - 1) for k in collections.Counter(s).values()) / 2, n * (n - 1) / 2
    rate = most / size
    crowded = math.exp(pairs - rate - pairs * math.log(pairs / rate)) if pairs > rate else 1.0
    two = lambda x: 2 * below(-abs(x))
    uniform = 3 * min(crowded, two((turns - (n - 1) * even) / math.sqrt((n - 1) * even * (1 - even))), two(z * math.sqrt(n - 3)))
    sd = math.sqrt(most * (ic * (1 - ic) + 2 * (n - 2) * (ic3 - ic * ic)))
    stay = sum(math.comb(n - 1, k) * (1 - said) ** k * said ** (n - 1 - k) for k in range(n - turns))
    tests = [below((pairs - most * ic) / sd), stay, below((z - math.atanh(S.CORRELATION)) * math.sqrt(n - 3))]
    y = sum(-2 * math.log(max(p, 1e-99)) for p in tests) / 2
    return uniform, -math.log10(max(2 * below(-math.sqrt(y)) + math.sqrt(2 * y / math.pi) * math.exp(-y / 2), 1e-299)) * S.STEPS


def test_battery_against_plain_python(spark):
    rng = random.Random(6)
    texts = [t.split()[-1].split("=")[-1] for _, t in planted(rng, 12)] + [rng.choice(NAMES) + rng.choice(NAMES) for _ in range(150)]
    texts += ["".join(rng.choice(ANY) for _ in range(rng.randrange(20, 30))) for _ in range(60)]
    told = {i: battery(t) for i, t in enumerate(texts)}
    told = {i: x for i, x in told.items() if x}
    # The false-discovery rule over all candidates, on the grid of steps.
    steps = {i: int(x[1]) for i, x in told.items()}
    admitted = [k for k in set(steps.values()) if len(steps) * 10 ** (-k / S.STEPS) <= S.FALSE_SHARE * sum(s >= k for s in steps.values())]
    want = {i for i in told if steps[i] >= min(admitted) and told[i][0] >= S.UNIFORM}
    # Candidates on the very border of a step or level may fall either way by rounding.
    border = {i for i, (uniform, step) in told.items() if abs(step - round(step)) < 1e-3 or abs(uniform - S.UNIFORM) < 1e-6}
    rows = [(i, i, S.BASE, 0, len(t), t) for i, t in enumerate(texts)]
    got = {r.doc_id for r in S.random_strings(spark.createDataFrame(rows, "doc_id long, key long, rank int, start long, end long, match string")).collect()}
    assert got ^ want <= border and 60 < len(want) < len(told), (got ^ want, len(want))
