"""From lists of items that share a key to verified links and components, without all pairs of a group.

Lists of up to ``LIGHT`` items yield their pairs.  In a longer list every item is compared with a leader
of the list.  What these links connect needs no further comparison within a component.  As long as
many items stand outside their lists' largest components, these are compared with another leader, drawn
from that component; each such round is linear in the lists.  At last the items still outside are
compared with the items of other components in their lists.  No link that would join two components is
lost, and no pair is verified twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS_KEPT, arrow_map, materialize, mix, release, signed, written

LIGHT = 16
#: Rounds of further leaders at most; and pairs left for each item of long lists that need no further round.
LEADER_ROUNDS, PAIRS_LEFT = 3, 16
#: Bits of the ids of which a table says whose sets are wanted.
ID_BITS = 26

Keep = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def shared_lists(postings: DataFrame, payload: list[str], orders: int, rank: str | None = None) -> DataFrame:
    """Postings (s, k, payload) of keys that at least two items have, with the list's size m and leader.

    A leader has the least ``rank``; of several it is drawn by one of ``orders`` orders, by the key of the
    list, so that a large group gets a few leaders.
    """
    dealt = postings.select("s", "k", *payload).repartition("s")
    order = F.struct(*([F.col(rank).alias("rank")] if rank else []), F.xxhash64("k", F.pmod("s", F.lit(orders))).alias("h"))
    lists = dealt.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(order.alias("r"), "k", *payload)).alias("lead")).filter("m > 1")
    return dealt.join(lists, "s")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def first_pairs(lists: DataFrame, payload: list[str], keep: Keep) -> DataFrame:
    light = lists.filter(F.col("m") <= LIGHT)
    x, y = light.alias("x"), light.alias("y")
    near = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.k") < F.col("y.k")) & keep(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    heavy = lists.filter((F.col("m") > LIGHT) & (F.col("k") != F.col("lead.k")) & keep(F.col, lambda c: F.col(f"lead.{c}")))
    return _pairs(near.select(F.col("x.k").alias("p"), F.col("y.k").alias("q")).unionAll(heavy.select(F.col("k").alias("p"), F.col("lead.k").alias("q"))), "p", "q")


def parity(h: np.ndarray, words: int) -> np.ndarray:
    """Of each of 64 * ``words`` cells whether an odd number of the hashes falls into it.

    Two sets differ in at least as many elements as their parities differ in bits.
    """
    cells = np.bincount((mix(h) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64)


def least_common(n: Column, m: Column, percent: int) -> Column:
    """Elements that sets of n and m have in common at least where their similarity reaches ``percent``."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(float(100 + percent)) - F.lit(1e-9))


def suffix_filter(x: Callable[[str], Column], y: Callable[[str], Column], percent: int, words: int) -> Column:
    """Whether the parities (columns n, bits) leave it open that two sets reach the similarity."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.get(x("bits"), F.lit(j)).bitwiseXOR(F.get(y("bits"), F.lit(j)))) for j in range(words)])
    return apart <= x("n") + y("n") - 2 * least_common(x("n"), y("n"), percent)


def _sieved(pairs: DataFrame, bits: DataFrame, sieve: Keep) -> DataFrame:
    x, y = bits.select(F.col("k").alias("a"), F.struct("n", "bits").alias("x")), bits.select(F.col("k").alias("b"), F.struct("n", "bits").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return both.filter(sieve(lambda c: F.col("x")[c], lambda c: F.col("y")[c])).select("a", "b")


def open_lists(heavy: DataFrame, labels: DataFrame) -> DataFrame:
    """The long lists of which some item isn't in the component of its leader, whole; written.

    An item has the same leader in many lists, so each pair of them is looked up once.
    """
    pairs = heavy.select("k", F.col("lead.k").alias("l")).filter("k <> l").distinct()
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    known = pairs.join(of("k"), "k", "left").join(of("l"), "l", "left")
    apart = known.filter(F.coalesce("k_label", "k") != F.coalesce("l_label", "l")).select("k", "l")
    rows = heavy.withColumn("l", F.col("lead.k")).drop("lead")
    keys = rows.join(apart, ["k", "l"], "left_semi").select("s").distinct()
    return materialize(rows.drop("l").join(keys, "s", "left_semi"))


def _placed(heavy: DataFrame, labels: DataFrame) -> DataFrame:
    """Long lists with the label of each item, the list's most frequent label and the size of what is outside it."""
    known = heavy.join(labels.select(F.col("id").alias("k"), "label"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    sizes = known.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("s").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("m")).select("s", "m", F.col("x.label").alias("most"), (F.col("m") - F.col("x.c")).alias("outside"))
    return known.drop("m").join(most.filter("outside > 0"), "s")


def leader_pairs(placed: DataFrame, payload: list[str], keep: Keep, orders: int, turn: int) -> DataFrame:
    """Pairs of the items outside a list's largest component with a leader from it."""
    order = F.xxhash64("k", F.pmod("s", F.lit(orders)), F.lit(turn))
    lead = placed.filter(F.col("label") == F.col("most")).groupBy("s").agg(F.min(F.struct(order.alias("r"), "k", *payload)).alias("lead"))
    met = placed.filter(F.col("label") != F.col("most")).join(lead, "s").filter(keep(F.col, lambda c: F.col(f"lead.{c}")))
    return _pairs(met.select(F.col("k").alias("p"), F.col("lead.k").alias("q")), "p", "q")


def left_pairs(placed: DataFrame, bits: DataFrame | None, keep: Keep, sieve: Keep | None) -> DataFrame:
    """Pairs of different components in long lists, one of them outside the list's largest component."""
    if bits is not None:
        placed = placed.join(bits.select("k", "bits"), "k")
    placed = materialize(placed)
    x, y = placed.filter(F.col("label") != F.col("most")).alias("x"), placed.alias("y")
    # two items outside the largest component meet twice here: once is enough
    once = (F.col("y.label") == F.col("x.most")) | (F.col("x.k") < F.col("y.k"))
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    near = keep(a, b) if sieve is None else keep(a, b) & sieve(a, b)
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & once & near)
    return _pairs(met.select(F.col("x.k").alias("p"), F.col("y.k").alias("q")), "p", "q")


def chosen_sets(texts: DataFrame, ids: DataFrame, homes: DataFrame, sets_in: Callable[[], Callable[[list], Iterable[tuple[int, Callable[[], np.ndarray]]]]]) -> DataFrame:
    """(k, h): the sets of the classes ``ids`` (k), each once and dealt by k, and perhaps of a few others.

    ``homes`` (k, th): hashes of texts that hold a class; one text of each class is looked at, the
    others aren't even cut into words.  ``sets_in()`` gives a task its function from texts to keys and
    (lazily) sets.  What reaches the driver is a table of 2 ** ID_BITS bits, however many ids there are.
    """
    home = materialize(homes.join(ids.distinct(), "k", "left_semi").groupBy("k").agg(F.min("th").alias("th")))
    words = np.zeros(1 << (ID_BITS - 6), np.uint64)
    if wanted := id_bits(home.select(F.explode(F.array("k", "th")).alias("k")), "k", ID_BITS):
        words[np.fromiter(wanted, np.int64, len(wanted))] = np.array(list(wanted.values()), np.int64).view(np.uint64)
    table = texts.sparkSession.sparkContext.broadcast(words)
    mask = (1 << ID_BITS) - 1

    def start():
        bits, sent, of = table.value, set(), sets_in()
        has = lambda x: (int(bits[(x & mask) >> 6]) >> (x & 63)) & 1

        def step(hashes, column):
            keys, sets = [], []
            for k, h in of([t for th, t in zip(hashes, column, strict=True) if has(th)]):
                if has(k) and k not in sent:
                    if len(sent) > KEYS_KEPT:
                        sent.clear()
                    sent.add(k)
                    keys.append(k)
                    sets.append(signed(h()))
            return [keys, sets]

        return step

    rows = texts.select(F.xxhash64("text").alias("th"), "text")
    return arrow_map(rows, "k long, h array<long>", start).groupBy("k").agg(F.first("h").alias("h"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity, exactly."""
    both = pairs.join(sets.select(F.col("k").alias("b"), F.col("h").alias("hb")), "b").join(sets.select(F.col("k").alias("a"), F.col("h").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.filter(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b")


def set_verifier(fetch: Callable[[DataFrame], DataFrame], percent: int) -> Callable[[DataFrame], DataFrame]:
    """A check of pairs on the sets that ``fetch(ids)`` gives.

    Sets come by one shuffle, which both sides of the pairs read, and aren't written.
    """
    return lambda pairs: verified(pairs, fetch(pairs.select(F.explode(F.array("a", "b")).alias("k"))), percent)


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the items in ``links`` (a, b): the smallest id that links reach.

    In each round all items of one label take the smallest label that any of them has for a neighbour;
    every aggregate is a minimum, so no list of neighbours is ever built.  Links within a label are
    dropped, and links between the same labels become one.  Labels only fall, so the rounds come to an end.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
    label = materialize(both.groupBy("id").agg(F.least("id", F.min("v")).alias("label")))
    step, left = label, links
    while True:
        # links between labels, from the greater to the smaller
        to = lambda c: step.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        at = lambda c: F.coalesce(f"{c}_label", c)
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.greatest(at("a"), at("b")).alias("a"), F.least(at("a"), at("b")).alias("b"))
        left = materialize(moved.filter("a <> b").distinct())
        if left.isEmpty():
            return label
        step = materialize(left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")))
        label = materialize(label.join(step.select(F.col("id").alias("label"), F.col("label").alias("lower")), "label", "left").select("id", F.coalesce("lower", "label").alias("label")))


def linked(postings: DataFrame, payload: list[str], keep: Keep, verify: Callable[[DataFrame], DataFrame], orders: int, bits: DataFrame | None = None, percent: int = 0, words: int = 0, rank: str | None = None, listed: Callable[[], None] = lambda: None, lists: Callable[..., DataFrame] = shared_lists) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect all that is connected, and the components (id, label).

    ``verify`` keeps the pairs (a, b) that are links.  ``bits``, if any: k, n, bits (parity) of every item,
    to drop pairs before.  ``rank``: a payload column that is least where an item is likely to be like most
    of a list.  ``listed`` is called when ``postings`` isn't read any more.  ``lists`` makes the lists of postings.
    """
    sieve = None if bits is None else (lambda x, y: suffix_filter(x, y, percent, words))
    spark = postings.sparkSession
    listings, where = written(lists(postings, payload, orders, rank))
    listed()

    def sieved(pairs: DataFrame) -> DataFrame:
        return pairs if bits is None else _sieved(pairs, bits, sieve)

    tried = materialize(sieved(first_pairs(listings, payload, keep)))
    heavy = materialize(listings.filter(F.col("m") > LIGHT))
    release(spark, [where])
    links = materialize(verify(tried))
    label = components(links)
    if heavy.isEmpty():
        return links, label
    heavy = open_lists(heavy, label)
    if heavy.isEmpty():
        return links, label

    def add(more: DataFrame) -> bool:
        nonlocal links, label, tried
        more = materialize(more.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            return False
        tried = tried.unionByName(more)
        new = materialize(verify(more))
        if new.isEmpty():
            return False
        links = links.unionByName(new)
        label = components(links)
        return True

    left = None
    for turn in range(LEADER_ROUNDS + 1):
        placed = materialize(_placed(heavy, label))
        # pairs that the last step would look at, and items; outside counts once for each item
        work = placed.agg(F.sum("outside").alias("pairs"), F.count(F.lit(1)).alias("items")).first()
        pairs = work["pairs"] or 0
        if turn == LEADER_ROUNDS or pairs <= PAIRS_LEFT * work["items"] or (left is not None and pairs > 0.8 * left):
            break
        left = pairs
        add(sieved(leader_pairs(placed, payload, keep, orders, turn)))
    add(left_pairs(placed, bits, keep, sieve))
    return links, label


def id_bits(ids: DataFrame, column: str, bits: int) -> dict[int, int]:
    """Which of 2**bits cells the hashed ids fall into, as 64-bit words: at most 2**(bits-6) rows reach the driver."""
    cell = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftrightunsigned(cell, 6)
    bit = F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))")
    return {r["w"]: r["v"] for r in ids.select(word.alias("w"), bit.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).collect()}
