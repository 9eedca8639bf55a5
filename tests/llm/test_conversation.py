"""Conversation repair against a table over all rows and states, and single edits."""

import collections
import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from codequarry.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, copies string, cost string"


def brute(rows):
    """{conv_id: result} of (conv_id, turn, role, text) rows, damaged and then repaired from the last row to the first."""
    by=collections.OrderedDict()
    for c,t,r,x in rows:
        by.setdefault(c,[])
        r=" " if r is None else r; x=" " if x is None else x
        k=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
        if k==0: continue
        if k==1: x=""
        if k==2: x=x.translate({ord(ch):None for ch in ".!?"})
        if k==4: r="user"
        by[c]+= [(t,r,x)]*(2 if k==3 else 1)
    out={}
    for c,rs in by.items():
        sha=lambda r,x: hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).hexdigest()
        rs=sorted(rs,key=lambda q:(q[0] is not None,q[0] or 0,q[1].encode(),q[2][:32].encode(),sha(q[1],q[2])))
        seen=set(); f=[]
        for t,r,x in rs:
            s=x.strip(" \t\n\x0b\x0c\r")
            if not s: f.append("b")
            elif (r,x) in seen: f.append("d")
            elif s[-1] not in ".!?": f.append("t")
            else: f.append("")
            seen.add((r,x))
        turns=[t for t,_,_ in rs if t is not None]
        gaps=max(turns)-min(turns)+1-len(set(turns)) if turns else 0
        ill=sum((a[1][:1]+"|"+b[1][:1]) not in ("s|u","u|a","a|u") for a,b in zip(rs,rs[1:]))
        # backward recursion over (row, last initial, pending inserts)
        def ok(last,n): return (n=="s" and last=="") or (n=="u" and last in ("","s","a")) or (n=="a" and last=="u")
        @lru_cache(None)
        def best(i,last,left):
            opts=[]
            if i==len(rs):
                if last in ("","a"): opts.append((0,"",()))
            if left:
                for n in "ua":
                    if ok(last,n):
                        b=best(i,n,left-1)
                        if b: opts.append((b[0]+2,"I"+b[1],({"u":"user:","a":"assistant:"}[n],)+b[2]))
            if i<len(rs):
                t,r,x=rs[i]; tr=f[i]=="t"
                b=best(i+1,last,3)
                if b: opts.append((b[0]+3,"D"+b[1],b[2]))
                if f[i] in ("","t"):
                    n=r[:1]
                    if ok(last,n):
                        b=best(i+1,n,3)
                        if b: opts.append((b[0]+tr,"K"+b[1],(f"{r}:{x}",)+b[2]))
                    for n in "ua":
                        if ok(last,n):
                            b=best(i+1,n,3)
                            if b: opts.append((b[0]+2+tr,"R"+b[1],({"u":"user:","a":"assistant:"}[n]+x,)+b[2]))
            return min(opts) if opts else None
        for i in range(len(rs),-1,-1):
            for left in range(4):
                for last in ("","s","u","a"): best(i,last,left)
        cost,audit,lines=best(0,"",3)
        out[c]=(gaps,f.count("b"),f.count("d"),f.count("t"),ill,cost,audit,hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def got(df):
    return {r[0]: tuple(r[1:]) for r in conversation.repair(conversation.damage(df), df).collect()}


def odd_rows():
    rnd = random.Random(3)
    rows = []
    for c in [None, *range(50)]:
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 40])):
            rows.append((c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "u2"]), rnd.choice(["a.", "b!", "c", "", None, " \n", "d?  ", "é… f", "x" * 40 + "."])))
    return rows + rows[:30]


def test_odd_rows(spark):
    assert got(table(spark, odd_rows())) == brute(odd_rows())


@pytest.mark.parametrize("partitions", [1, 9])
def test_a_conversation_in_many_segments_and_tasks(spark, partitions):
    rnd = random.Random(4)
    rows = [(5, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b!", "c", "g"]) + str(rnd.randrange(900)) + rnd.choice([".", ""])) for i in range(1300)]
    rows += [(c, i, "user", "a b.") for c in (4, 6) for i in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(table(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert {r[0]: tuple(r[1:]) for r in conversation.op12_conversation_repair(spark, folder).collect()} == brute([tuple(r) for r in rows.collect()])


def test_empty_tables(spark):
    df = table(spark, [])
    assert got(df) == {}
    gone = table(spark, [(1, None, None, None)]).where("turn = 1")
    out = conversation.repair(conversation.damage(gone), table(spark, [(1, None, None, None)])).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def plain(rows):
    """The best (cost, audit) by trying every edit at every row."""
    best = None
    todo = [(0, 0, 0, "", 0)]
    while todo:
        i, state, cost, audit, inserts = todo.pop()
        if i == len(rows) and state in conversation.ENDS and (best is None or (cost, audit) < best):
            best = cost, audit
        for e, j, t, c in conversation.edits(rows, i, state):
            if e != "I" or inserts < 2:
                todo.append((j, t, cost + c, audit + e, inserts + 1 if e == "I" else 0))
    return best


def test_branch_and_bound_is_optimal():
    rnd = random.Random(6)
    for _ in range(150):
        rows = [rnd.choice([1, 2, ("s", False), ("u", False), ("a", False), ("u", True), ("a", True), ("", False), ("t", True)]) for _ in range(rnd.randint(0, 4))]
        assert conversation.cheapest(rows, conversation.START, conversation.ENDS) == plain(rows)


def test_segments_chain_to_the_whole():
    rnd = random.Random(7)
    for _ in range(100):
        rows = [rnd.choice([1, ("s", False), ("u", False), ("a", False), ("u", True), ("x", False)]) for _ in range(12)]
        best, at = {conversation.START: (0, "")}, 0
        while at < len(rows):
            n = rnd.randint(1, 4)
            segment = conversation.Segment()
            segment.rows = rows[at : at + n]
            best, at = conversation.chained(best, segment.paths()), at + n
        assert min(best[s] for s in conversation.ENDS if s in best) == conversation.cheapest(rows, conversation.START, conversation.ENDS)
