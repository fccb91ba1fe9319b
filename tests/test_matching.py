"""Names of models against one name at a time in plain Python."""

import random
import re

from tracemill.operators import catalogs, matching

ENTRY = f"id string, provider string, name string, consensus boolean, rates {catalogs.RATES}"


def key(s):
    return re.sub(r"(?<=\d)\.(?=\d)", "-", s).lower()


def bare(s):
    return re.sub(r"([-@]\d{8}|-\d{4}-\d{2}-\d{2})$", "", s)


def shown(s):
    return re.sub(r"^(.*[^0-9])[0-9]{4,8}$", r"\1", re.sub("[^a-z0-9]", "", s.lower()))


def words(s):
    return [w for w in re.findall("[a-z]+|[0-9]+", bare(s).lower()) if not re.fullmatch("[0-9]{6,}", w)]


def runs(ws):
    return sorted(re.findall("[0-9]+(?: [0-9]+)*", " ".join(ws)))


class Plain:
    def __init__(self, entries):
        self.entries = {e[0]: e for e in entries}
        self.exact, dated = {}, {}
        for e in sorted(entries):
            self.exact.setdefault(key(e[0]), e[0])
            if key(bare(e[0])) != key(e[0]):
                dated[key(bare(e[0]))] = e[0]
        for k, i in dated.items():
            self.exact.setdefault(k, i)

    def median(self, i):
        return self.entries[i][3]

    def display(self, name):
        k = shown(name)
        same = sorted(e for e in self.entries.values() if not e[3] and e[2] and shown(e[2]) == k)
        owners = [e for e in same if k.startswith(e[1])]
        if len(same) == 1 or (same and len(owners) != 1 and len({e[4][:3] for e in same}) == 1):
            return same[0][0]
        return owners[0][0] if len(owners) == 1 else None

    def lookup(self, name):
        i = self.exact.get(key(name)) or self.exact.get(key(bare(name)))
        if i and not self.median(i):
            return i, True
        d = self.display(name)
        return (d, False) if d else (i, True) if i else None

    def windows(self, name):
        spans = [m.span() for m in re.finditer("[^-:]+", name)]
        for n in range(len(spans) - 1, 0, -1):
            for s in range(len(spans) - n, -1, -1):
                win = name[spans[s][0] : spans[s + n - 1][1]]
                if not any(name[a:b].lower() in matching.TIERS for a, b in spans[s + n :]) and re.match("[A-Za-z]", win) and (n > 1 or re.search("[0-9]", win)):
                    yield win

    def similar(self, name):
        ws, best = words(name), []
        for i, e in self.entries.items():
            cs = words(i)
            tiers = all(w in cs or (set(cs) & set(matching.FAMILIES) and w in matching.EFFORTS) for w in ws if w in matching.TIERS)
            if len(ws) > 1 and len(cs) > 1 and cs[0] in ws and 2 * len(cs) >= len(ws) and all(cs.count(c) <= ws.count(c) for c in cs) and runs(cs) == runs(ws) and tiers:
                best.append((-len(cs), e[3], i))
        return min(best)[2] if best else None

    def nearest(self, name):
        k = key(bare(name))
        if not re.match("[a-z].*[0-9]", k):
            return None
        form, nums = re.sub("[0-9]+", "#", k), [int(x) for x in re.findall("[0-9]+", k)]
        found = [(sum(abs(a - int(b)) for a, b in zip(nums, re.findall("[0-9]+", key(bare(i))))), i) for i in self.entries if re.sub("[0-9]+", "#", key(bare(i))) == form]
        return min(found)[1] if found else None

    def resolve(self, model):
        base, before = model.strip().rsplit("/", 1)[-1].strip(), None
        while base != before:
            before, base = base, re.sub(r"\s*(\[[^\[]*\]|\([^(]*\))$", "", base).strip()
        if not base:
            return "none", None
        ws, names = [w for w in re.split("[-:]", key(base)) if w], [base]
        f = next((k for k, w in enumerate(ws) if w in matching.FAMILIES), 0)
        if ws[:1] == ["claude"] and f >= 2 and all(w.isdigit() for w in ws[1:f]):
            names.append("-".join(["claude", ws[f], *ws[1:f], *ws[f + 1 :]]))
        if len(ws) > 1 and ws[0] in matching.FAMILIES and ws[1].isdigit():
            names.append("claude-" + "-".join(ws))
        hits = [(*h, n) for n, name in enumerate(names) if (h := self.lookup(name))]
        if hits:
            i, by_id, n = next((h for h in hits if not self.median(h[0])), hits[0])
            return ("exact" if by_id and n == 0 else "approx"), i
        parts = [next((h[0] for w in self.windows(name) if (h := self.lookup(w))), None) for name in names]
        parts = [p for p in parts if p]
        part = next((p for p in parts if not self.median(p)), parts[0] if parts else None)
        like = self.similar(base)
        for i in (part if part and not self.median(part) else None, like if like and not self.median(like) else None, part, like):
            if i:
                return "approx", i
        for i in [*(self.nearest(n) for n in names), *(self.nearest(w) for n in names for w in self.windows(n))]:
            if i:
                return "approx", i
        return "none", None


def test_equals_one_name_at_a_time(spark):
    rng = random.Random(12)
    stems, tiers, ends = ["claude", "orca", "lark", "opus", "sonnet", "finch", "llama"], ["mini", "pro", "max", "flash", "opus", "haiku"], ["high", "thinking", "free", "x", "preview"]
    version = lambda: rng.choice(["4", "4.5", "5", "3-1", "5.5", "70b", "4o"])

    def name(noise):
        out = [rng.choice(stems)] + [x for x, p in ((version(), 0.8), (rng.choice(tiers), 0.5), (version(), 0.15)) if rng.random() < p]
        if noise:
            out = [rng.choice(["cli", "my", "q7"]) for _ in range(rng.choice([0, 0, 1, 2]))] + out + [rng.choice(ends + tiers) for _ in range(rng.choice([0, 0, 1, 2]))]
            if rng.random() < 0.3:
                rng.shuffle(out)
        tail = rng.choice(["", "", "", "-20250101", "@20240505", "-2025-03-04"])
        return rng.choice(["-", "-", "-", ":"]).join(out) + tail

    entries, seen = [], set()
    while len(entries) < 90:
        i = name(False)
        if key(i) not in seen:
            seen.add(key(i))
            median = rng.random() < 0.3
            title = None if median or rng.random() < 0.5 else rng.choice([i.replace("-", " ").title(), f"{rng.choice(stems).title()} {version()}", "Claude Five 1017"])
            entries.append((i, rng.choice(["claude", "orca", "vendor"]), title, median, (float(rng.randrange(1, 3)), 1.0, None, None, [])))
    models = {rng.choice(["", "", "shop/", "a/b/"]) + name(rng.random() < 0.7) + rng.choice(["", "", "[1m]", " (high)", " [x] (y)"]) for _ in range(500)}
    models |= {e[0].upper() for e in entries[:10]} | {e[2] for e in entries if e[2]} | {"", " ", "/", "[1m]", "7", "---", "opus-5.5", "claude-4.5-opus-high-thinking", "x" * 300}
    got = {r["model"]: (r["match_kind"], r["id"]) for r in matching.resolved(spark.createDataFrame([(m,) for m in models] + [(None,)], "model string"), spark.createDataFrame(entries, ENTRY)).collect()}
    plain = Plain(entries)
    assert {m: g for m, g in got.items() if g != plain.resolve(m)} == {}
    assert set(got) == models and {k for k, _ in got.values()} == {"exact", "approx", "none"}
    none = spark.createDataFrame([], ENTRY)
    assert {r["match_kind"] for r in matching.resolved(spark.createDataFrame([("m-1",)], "model string"), none).collect()} == {"none"}
