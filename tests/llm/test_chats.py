import random
import re

from seriata.llm import chats as C
from seriata.llm.chats import link_quotes, transcripts

TALK = [
    (1, 0, "user", "How do I  sort a list?\nIt has numbers."),
    (1, 1, "assistant", "Use sorted()."),
    (1, 2, "user", "> use SORTED().\nAnd descending?"),
    (1, 3, "assistant", ">> Use sorted().\n> And descending?\nPass reverse=True.\n"),
    (1, 4, "user", "> How do I sort a list?\n> It has numbers.\nStill curious\n> It has numbers.\nabout it"),
    (1, 5, "user", "> nobody said this\nfine"),
    (2, 0, None, "no quotes > here"),
    (2, 1, "user", None),
    (3, 4, "user", "> Use sorted().\nother conversation"),
    (None, 0, "user", "> x\ny"),
    (2, 0, None, "no quotes > here"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, 5) for r in TALK], "conv_id long, turn long, role string, text string, path int")
    out = link_quotes(df)
    rows = out.collect()
    assert len(rows) == len(TALK)
    by = {(r.conv_id, r.turn): r for r in rows}
    assert {k: r.reply_to for k, r in by.items() if r.reply_to is not None} == {(1, 2): 1, (1, 3): 2, (1, 4): 0}
    assert [(by[1, t].root, by[1, t].depth) for t in (3, 4, 5)] == [(1, 2), (0, 1), (5, 0)]
    assert by[1, 2].body == "And descending?" and by[1, 3].body == "Pass reverse=True." and by[1, 4].body == "Still curious\nabout it"
    assert by[2, 0].body == "no quotes > here" and by[2, 1].body == "" and by[None, 0].body == "y"
    talk = {(r.conv_id, r.part): r for r in transcripts(out).collect()}
    assert all(r.cut in (0, None) for r in talk.values())
    assert talk[1, 0].turns == [0, 4, 1, 2, 3, 5]
    assert talk[1, 0].chat.startswith("<|user|>\nHow do I  sort a list?\nIt has numbers.\n<|end|>\n<|user|>\nStill curious\nabout it\n<|end|>\n<|assistant|>\nUse sorted().")


def brute(rows):
    """The answered turn of each message, by comparing normalised passages, lines and sentences one by one."""
    norm = lambda x: " ".join(x.lower().split())

    def parse(text):
        runs, last = [], None
        for line in text.split("\n"):
            level, rest = 0, line
            while rest.lstrip(" \t").startswith(">") and len(rest) - len(rest.lstrip(" \t")) <= 3:
                rest = rest.lstrip(" \t")[1:]
                level += 1
            rest = rest.lstrip(" ") if level else line
            if last is not None and runs[-1][0] == level and rest.strip(" ") and last.strip(" "):
                runs[-1][1].append(rest)
            else:
                runs.append((level, [rest]))
            last = rest
        out = {}
        for lv, ls in runs:
            whole = " ".join(ls)
            for w, x in [*((1, y) for y in ls), *((1, y) for y in re.split(r"(?<=[.!?])\s+", whole)), (2, whole)]:
                if norm(x):
                    out[lv, norm(x)] = max(w, out.get((lv, norm(x)), 0))
        return out

    out = {}
    parsed = [(c, t, parse(x)) for c, t, x in rows]
    for c, t, said in parsed:
        found = {}
        for (lv, x), w in said.items():
            earlier = [t2 for c2, t2, s2 in parsed if c2 == c and t2 < t and (0, x) in s2]
            if lv and earlier:
                found[-lv, max(earlier)] = found.get((-lv, max(earlier)), 0) + w
        out[c, t] = max(((lv, w, t2) for (lv, t2), w in found.items()), default=(0, 0, None))[2]
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    words = ["alpha beta", "Gamma  delta.", "eps", "zeta eta. theta", ""]
    rows = []
    for c in range(12):
        said = []
        for t in range(8):
            lines = []
            for _ in range(r.randrange(1, 5)):
                lines.append("> " * r.randrange(0, 3) + (r.choice(said) if said and r.random() < 0.6 else r.choice(words) + str(r.randrange(9))))
            said += [x.lstrip("> ") for x in lines]
            rows.append((c, t, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): x.reply_to for x in link_quotes(df).collect()}
    assert got == brute(rows) and sum(v is not None for v in got.values()) > 30
    assert link_quotes(df.limit(0)).count() == 0 and transcripts(link_quotes(df.limit(0))).count() == 0


def test_parts_of_messages_and_ties(spark):
    rows = [(1, 0, "First part. It has two sentences.\n\nSecond part\nof two lines"), (1, 1, "> second part of\n> two lines\nyes"), (1, 2, "> It has two sentences.\nindeed"), (1, 3, "same words"), (1, 4, "same words"), (1, 5, "> same words\nthe latest of equals")]
    got = {x.turn: x.reply_to for x in link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: None, 4: None, 5: 4}


def test_long_threads_and_texts(spark):
    """A thread longer than a cut goes on in the next one; a common phrase is looked up far back."""
    n = 2500
    rows = [(1, t, "user", f"> message {t - 1} here\nmessage {t} here" if t else "message 0 here\ncommon phrase") for t in range(n)]
    rows += [(2, 0, "user", "common phrase"), (2, 4000, "user", "> common phrase\n" + "long line " * 100_000)]
    linked = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {(x.conv_id, x.turn): (x.reply_to, x.root, x.depth) for x in linked.select("conv_id", "turn", "reply_to", "root", "depth").collect()}
    assert all(by[1, t] == (t - 1, 0, t) for t in range(1, n)) and by[2, 4000] == (0, 0, 1)
    talk = sorted((x.conv_id, x.part, x.cut, x.turns) for x in transcripts(linked).select("conv_id", "part", "cut", "turns").collect())
    assert [t for c, _, _, turns in talk if c == 1 for t in turns] == list(range(n))
    assert max(len(turns) for *_, turns in talk) <= C.CUT + C.PART


def test_query_gives_conversations(spark, tmp_path):
    from seriata.llm.queries import op4_chats

    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    talk = {(r.conv_id, r.part): r for r in op4_chats(spark, str(tmp_path)).collect()}
    assert talk[1, 0].turns == [0, 4, 1, 2, 3, 5] and talk[1, 0].replies == [None, 0, None, 1, 2, None]
    assert talk[2, 0].turns == [0, 0, 1] and talk[None, 0].chat == "<|user|>\ny\n<|end|>\n"
    assert talk[1, 0].chat.count("<|end|>") == 6
