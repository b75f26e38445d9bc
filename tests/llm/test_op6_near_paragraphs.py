import random

from tallyrec.llm import passages

rng = random.Random(6)


def words(n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_near_copies_of_whole_paragraphs_stay_once(spark):
    rows = []
    for k, (n, changed) in enumerate([(60, 1)] * 20 + [(100, 2)] * 20):
        own = words(n)
        copy = list(own)
        for j in rng.sample(range(10, n - 10), changed):
            copy[j] = "changed"
        rows += [(2 * k, "\n".join([*(" ".join(x) for x in (words(40), own, words(40)))])), (2 * k + 1, "\n".join([*(" ".join(x) for x in (words(30), copy, words(50)))]))]
    out = {r.doc_id: r.text for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        left = text.split("\n")
        if d % 2 == 0:
            assert out[d] == text
        else:
            assert out[d].split() == (left[0] + " " + left[2]).split()


def test_a_kept_paragraph_is_not_removed_by_its_own_block(spark):
    body = " ".join(words(70))
    rows = [(d, f"{' '.join(words(30))}\n\nTitle {d}\n{body}\n\n{' '.join(words(30))}") for d in range(3)]
    out = {r.doc_id: r.text for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d in range(3) if body in out[d]] == [0]
