"""Feature families against plain counting, text by text."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.functions import text as X
from inkwell.operators import features as FE

HAN = re.compile("[一-鿿]")


def han(s):
    return len(HAN.findall(s))


def lines(t):
    return [x.strip() for x in t.splitlines() if x.strip()]


def interval(name, x, edges):
    for e in edges:
        if x <= e:
            return f"{name}:le_{e}"
    return f"{name}:gt_{edges[-1]}"


def marks(t):
    out = Counter()
    for c in t:
        out[f"punc:{c}"] += c in FE.MARKS
        out[f"dialogue_mark:{c}"] += c in FE.SPEECH
    p = lines(t)
    out[interval("dialogue_line_ratio", 100 * len([x for x in p if x.startswith(("“", '"', "「", "『"))]) / (len(p) or 1), (5, 15, 30, 50, 75))] = 1
    out[interval("quote_count", sum(map(t.count, FE.SPEECH)), (2, 6, 12, 24, 48))] = 1
    out[interval("colon_count", t.count(":") + t.count("："), (1, 3, 6, 12, 24))] = 1
    out[interval("ellipsis_count", t.count("…"), (1, 2, 4, 8, 16))] = 1
    return +out


def lengths(t):
    p, s = [han(x) for x in lines(t)], [han(x) for x in re.split("[。！？!?]+", t) if han(x)]
    out = Counter([interval("paragraph_count", len(p), (1, 2, 4, 8, 16, 32)), interval("sentence_count", len(s), (3, 6, 10, 16, 24, 40))])
    for x in s:
        out[interval("sentence_cjk", x, (8, 16, 28, 45, 70, 110, 180))] += 1
    for x in p:
        out[interval("paragraph_cjk", x, (30, 70, 120, 200, 340, 560, 900))] += 1
    if s:
        out[interval("avg_sentence_cjk", np.mean(s), (12, 20, 32, 48, 72, 110))] += 1
    if p:
        out[interval("avg_paragraph_cjk", np.mean(p), (40, 80, 140, 220, 360, 600))] += 1
    return out


def characters(t):
    out = Counter(f"function_char:{c}" for c in t if c in X.FUNCTION_CHARS)
    out[interval("function_ratio", 100 * sum(out.values()) / max(1, han(t)), (20, 30, 40, 50, 60, 70))] += 1
    return out


def found_words(t):
    out, k = [], 0
    while k < len(t):
        w = max((w for w in FE.WORD_GROUP if t.startswith(w, k)), key=len, default=None)
        out += [w] if w else []
        k += len(w) if w else 1
    return out


def words(t):
    w = found_words(t)
    out = Counter(f"function_word:{x}" for x in w) + Counter(f"function_word_group:{FE.WORD_GROUP[x]}" for x in w)
    out[interval("function_word_ratio", 1000 * len(w) / max(1, han(t)), (2, 5, 10, 20, 35, 55, 80, 120))] += 1
    out[interval("function_word_diversity", len(set(w)), (2, 4, 8, 12, 18, 26, 36, 50))] += 1
    return out


def grams(s, name=""):
    return Counter(name.format(n) + s[k : k + n] for n in (2, 3, 4) for k in range(len(s) - n + 1))


def stripped(t):
    return sum((grams(x) for x in re.split("某+", "".join(t.split()))), Counter())


def topology(t):
    s = "".join(HAN.findall(t))
    runs, gaps = [len(x) for x in re.findall("某+", s)], [len(x) for x in re.split("某+", s) if x]
    out = {"cjk_count": len(s), "mask_fraction": sum(runs) / max(1, len(s)), "run_count_per_1k": 1000 * len(runs) / max(1, len(s))}
    for k, v in (("run", runs), ("gap", gaps)):
        if v:
            out |= {f"{k}_length_mean": np.mean(v), f"{k}_length_max": max(v)}
    return out


def spread(v, name, short, long, qs=(10, 25, 50, 75, 90)):
    out = {f"mean_{name}": np.mean(v) if v else 0, f"sd_{name}": np.std(v) if v else 0}
    out |= {f"p{q}_{name}": np.percentile(v, q) if v else 0 for q in qs}
    return out | {f"short_{name}": sum(x <= short for x in v) / max(1, len(v)), f"long_{name}": sum(x >= long for x in v) / max(1, len(v))}


def shares(seq, n, prefix):
    g = [">".join(seq[k : k + n]) for k in range(len(seq) - n + 1)]
    return {prefix + k: v / len(g) for k, v in Counter(g).items()}


def rhythm(t):
    s = [x for x in re.findall("[^。！？!?]+[。！？!?]*", t) if han(x)]
    out = spread([han(x) for x in s], "sentence", 12, 40) | spread([han(c) for x in s for c in re.split("[，,；;：:]", x) if han(c)], "clause", 6, 24)
    shape = [f"{'S' if han(x) <= 12 else 'M' if han(x) <= 32 else 'L'}.{min(3, x.count('，') + x.count(','))}.{ {'？': 'Q', '?': 'Q', '！': 'E', '!': 'E'}.get(x.strip()[-1:], 'D') }" for x in s]
    return out | shares(shape, 1, "shape:") | shares(shape, 2, "shapes:")


def grammar(t):
    w = found_words(t)
    out = Counter()
    for x in w:
        out[f"rate:{x}"] += 1000 / max(1, han(t))
        out[f"group:{FE.WORD_GROUP[x]}"] += 1000 / max(1, han(t))
    steps, k = [], 0
    while k < len(t):
        x = max((w for w in FE.WORD_GROUP if t.startswith(w, k)), key=len, default=None)
        steps += [x] if x else ["|"] if t[k] in "。！？!?" else []
        k += len(x) if x else 1
    return dict(out) | shares(steps, 2, "next:") | {"diversity": len(set(w)) / max(1, len(w))}


def discourse(t):
    p = lines(t)
    n = [han(x) for x in p]
    kind = ["dialogue" if x[0] in FE.OPENING else "question" if x[-1] in "？?" else "attribution_open" if any(c in x[:18] for c in FE.SAYING) else "narration" for x in p]
    sized = [f"{k}.{'S' if x <= 15 else 'M' if x <= 60 else 'L'}" for k, x in zip(kind, n)]
    sent = [sum(han(s) > 0 for s in re.split("[。！？!?]", x)) for x in p]
    out = spread(n, "paragraph", 15, 80, (25, 50, 75, 90))
    out |= {"variation_paragraph": np.std(n) / max(1, np.mean(n)) if n else 0, "mean_sentences": np.mean(sent) if sent else 0, "p90_sentences": np.percentile(sent, 90) if sent else 0, "single_sentence": sent.count(1) / max(1, len(sent))}
    out |= shares(kind, 1, "kind:") | shares(kind, 2, "kinds:")
    for k in (1, 2, 3):
        out |= shares(sized, k, f"sequence{k}:")
    pairs = list(zip(kind, kind[1:]))
    out["question_response"] = sum(a == "question" and b in ("dialogue", "attribution_open") for a, b in pairs) / max(1, len(pairs))
    out["alternation"] = sum({a, b} == {"dialogue", "narration"} for a, b in pairs) / max(1, len(pairs))
    runs = [len(r) for r in re.findall("d+", "".join(k[0] for k in kind))]
    return out | {"dialogue_run_mean": np.mean(runs) if runs else 0, "dialogue_run_max": max(runs, default=0)}


PLAIN = {
    "char_ngrams": lambda t: grams("".join(t.split()), "char{}:"), "punctuation_dialogue": marks, "length_shape": lengths, "function_chars": characters, "function_words": words,
    "function_words_plus_chars": lambda t: characters(t) + words(t), "combined_interpretable": lambda t: marks(t) + lengths(t) + characters(t), "combined_rich_function_words": lambda t: marks(t) + lengths(t) + characters(t) + words(t),
    "mask_stripped_ngrams": stripped, "mask_topology": topology, "sentence_rhythm": rhythm, "function_grammar": grammar, "paragraph_discourse": discourse,
}


def made():
    rng = random.Random(4)
    bits = [*"天地玄黄某某雪说问的了是，。！？…：“”「」 \n\n\t\r,.!?a1", *list(FE.WORD_GROUP)[::9], "\u3000", "\u2028", "\x1c"]
    return ["", " \n", "天", "a" * 300, "天" * 3000, "“好？”\n他说好。\n走！", "某" * 20, "“因为不得不走。”他说：\n雪……落！"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 200))) for _ in range(30)]


@pytest.mark.parametrize("family", sorted(FE.FAMILIES))
def test_family(spark, family):
    rows = [(i, t, "x", 1) for i, t in enumerate(made())] + [(900, None, "x", 1), (901, "天。", "x", 1), (901, "天。", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string, id int")
    got = defaultdict(list)
    for r in FE.feature_counts(df, "doc_id", "text", family).collect():
        got[r["id"]].append((r["feature"], r["value"]))
    assert 900 not in got and len(got[901]) == 2 * len(PLAIN[family]("天。"))
    for i, t, *_ in rows[:-3]:
        assert len(got[i]) == len(dict(got[i]))
        assert dict(got[i]) == pytest.approx({k: float(v) for k, v in PLAIN[family](t).items()}, abs=1e-9), t
