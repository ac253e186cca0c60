from parcelwise.llm import simhash


def test_texts_under_one_id_are_rows_of_their_own(documents):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    copies = [(1, texts[0]), *((i, texts[0]) for i in range(2, 7)), (6, texts[0])]
    own = [(i, texts[i]) for i in range(2, 7)] + [(6, texts[7]), (8, texts[8]), (8, texts[9]), (8, texts[9])]
    found = simhash.one_per_component(documents(*copies, *own)).select("doc_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted({(1, texts[0]), *own})
