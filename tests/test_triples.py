"""Triples by parts of their names, against plain containment."""

from docmill.operators import enrich


def plain(triples, asked, per_entity, overall):
    out = []
    for q in sorted({a[0] for a in asked}):
        seen, rows = set(), []
        for _, _, entity in sorted(a for a in asked if a[0] == q):
            if entity:
                own = [t for t in triples if entity.lower() in (t[1] or "").lower() or entity.lower() in (t[3] or "").lower()][:per_entity]
                for t in own:
                    key = tuple(x.lower() for x in t[1:])
                    if key not in seen:
                        seen.add(key)
                        rows.append(t)
        out += [(q, k + 1, *t[1:]) for k, t in enumerate(rows[:overall])]
    return out


def test_against_containment(spark):
    names = ["Acme Corp", "acme", "John Smith", "SMITH & Sons", "Éclair %", "a_b", "X", "Johnson", "aaaa", "aaab", "Corp of Acme Corp"]
    triples = [(i, names[i % 11], ["knows", "Owns", "owns"][i % 3], names[(i * 7 + i // 11) % 11]) for i in range(120)]
    asked = [(1, 0, "acme"), (1, 1, "smith"), (2, 0, "éclair"), (2, 1, "%"), (3, 0, "x"), (4, 0, "a_"), (5, 0, ""), (5, 1, "nobody"), (6, 0, "aaa"), (6, 1, "AAAA"), (7, 0, "corp of acme corp"), (8, 0, "ACME CORP"), (9, 0, "n")]
    t = spark.createDataFrame(triples, "i int, subject string, predicate string, object string")
    for ask in (asked, [a for a in asked if len(a[2]) != 1 and len(a[2]) != 2]):
        for limits in ((20, 20), (3, 4)):
            out = enrich.triples_for_entities(t, spark.createDataFrame(ask, "query_id int, pos int, entity string"), ["i"], *limits)
            assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
            assert sorted(map(tuple, out.collect())) == plain(triples, ask, *limits)
