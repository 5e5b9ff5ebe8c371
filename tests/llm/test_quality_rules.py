import re
from collections import Counter

from tessella.llm import quality_rules


def plain(rows, max_documents, max_share):
    """The rules by brute force: (doc_id, base columns, kept)."""
    def normal(text):
        flat = re.sub(r"[ \t\x0b\x0c\r]+", " ", (text or "").lower())
        return [x for x in (line.strip(" ") for line in flat.split("\n")) if x]

    held = Counter((h, x) for _, t, h in rows for x in set(normal(t)))
    docs = Counter(h for _, _, h in rows)
    out = []
    for i, t, h in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = Counter(grams)
        repeat = len({k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        common = sum(len(x.split(" ")) for x in normal(t) if held[h, x] > max_documents and held[h, x] > max_share * docs[h])
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        kept = not failed and (len(words) - common) * 2 >= len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, failed, kept, common))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    fresh = " ".join(f"w{k}" for k in range(60))
    menu = " ".join(f"Menu{k}" for k in range(70))
    rows = [(k, f"{menu}\n{fresh} {k}\nshort", "a") for k in range(30)]
    rows += [(100 + k, f"{menu.lower()}  \n\n {fresh}\n{fresh}\n{fresh}", "b") for k in range(3)]
    rows += [(200, None, None), (201, "", None), (202, " \n\t\r\n ", "a"), (203, "é ü " * 40, "a"), (204, "x# $y <b>\n" * 30, None), (None, fresh, "c"), (None, fresh, "c"), (7, "other " + fresh, "a"), (205, fresh * 400, "c"), (206, fresh + " w0 w1 w2 w3", "c")]
    docs = spark.createDataFrame([(i, t, h, 1, "z") for i, t, h in rows], "doc_id long, text string, source string, n_words int, _words string")
    found = sorted(map(tuple, quality_rules.apply_rules(spark, docs).collect()), key=str)
    assert found == plain(rows, 20, 0.01)
    assert {r[-2] for r in found if r[-1]} == {False} and sum(r[-2] for r in found) > 3
    assert quality_rules.apply_rules(spark, docs.limit(0)).count() == 0
