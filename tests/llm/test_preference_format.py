import itertools

from veritrail.llm import preference_format as pf


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)
    masks = []
    for side in (chosen, rejected):
        out, at = [], len(show(side[:n]))
        for r, t in side[n:]:
            size = len(show([(r, t)]))
            if r == "assistant":
                out.append((at + len(f"<|{r}|>\n"), at + size))
            at += size
        masks.append(out)
    return (n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), *masks)


def test_pairs_equal_the_plain_rule(spark):
    turn = [("user", "hé"), ("assistant", "a😀"), ("assistant", None), (None, "x"), ("system", "")]
    pairs = [(c, r) for a, b in itertools.product(range(4), repeat=2)
             for c, r in [([turn[(a * 2 + i) % 5] for i in range(a + 1)], [turn[(b * 2 + i) % 5] for i in range(b + 1)])]]
    pairs += [(turn[:3], turn[:3]), (turn[:2], []), ([], turn[1:3]), ([("user", "long " * 20_000)], [("user", "long " * 20_000), turn[1]])]
    as_rows = lambda side: [(i, k, r, t, 9) for i, p in enumerate(pairs) for k, (r, t) in enumerate(p[side])] + [(None, 0, "user", "q", 9)]
    schema = "pair long, turn long, role string, text string, prompt int"
    out = pf.format_preferences(spark.createDataFrame(as_rows(0), schema), spark.createDataFrame(as_rows(1), schema))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    done = {r.pair: r for r in out.collect()}
    assert set(done) == set(range(len(pairs)))
    for i, (c, r) in enumerate(pairs):
        c, r = [[(x or "", y or "") for x, y in s] for s in (c, r)]
        got = done[i]
        assert (got.prompt_turns, got.prompt, got.chosen, got.rejected, [tuple(m) for m in got.chosen_mask],
                [tuple(m) for m in got.rejected_mask]) == plain(c, r)


def test_repeated_and_empty(spark):
    schema = "pair long, turn long, role string, text string"
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], schema)
    row = pf.format_preferences(twice, twice).collect()[0]
    assert row.prompt_turns == 2 and row.chosen == ""
    assert pf.format_preferences(twice.where("false"), twice.where("false")).count() == 0
