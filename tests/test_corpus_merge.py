"""The chunk store: a merge equals a full build, touches no other bucket and survives interruptions."""

import pytest

from docflow.plans import corpus
from docflow.sources.buckets import BucketTable

PAGES = "page_id bigint, url string, html string"
DAY = "2026-02-01"


def page(k, text):
    return (k, f"https://h.org/{k}", f"<html><head><title>P{k}</title></head><body><main><h1>Titre {k}</h1><p>{text} de la page numero {k}</p></main></body></html>")


def inputs(spark, pages, texts):
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(texts, "file string, text string")


def chunks(store):
    rows = store.chunks.rows().drop("bucket")
    return sorted(map(str, rows.select(*sorted(rows.columns)).collect()))


def built(spark, tmp_path, name, pages, texts):
    store = corpus.ChunkStore(spark, str(tmp_path / name), 5)
    corpus.merge_refresh(*inputs(spark, pages, texts), store, DAY)
    return store


def sheet(k, word):
    return (f"guide_{k}.docx", f"FICHE  001 - volet {k}\n{word} du guide {k}\nFICHE  002 - suite {k}\nune autre phrase ici")


FIRST = [page(k, "Un premier texte assez long") for k in range(12)], [sheet(k, "contenu") for k in range(9)]
LATER = (
    [page(k, "Un premier texte assez long" if k % 4 else "Une autre phrase, plus longue") for k in range(2, 14)],
    [sheet(k, "contenu" if k != 3 else "nouveau") for k in range(1, 9)] + [sheet(20, "contenu"), ("vide.docx", "")],
)


def test_merge_equals_full_build(spark, tmp_path):
    store = built(spark, tmp_path, "a", *FIRST)
    done = corpus.merge_refresh(*inputs(spark, *LATER), store, DAY)
    whole = built(spark, tmp_path, "b", *LATER)
    assert chunks(store) == chunks(whole) and len(chunks(store)) > 20
    state = lambda s: sorted(map(tuple, s.sources.rows().select("kind", "name", "sha256", "n_chunks").collect()))
    assert state(store) == state(whole) and ("docx", "vide.docx") in {r[:2] for r in state(store)}
    counts = {r.kind: (r.n_added, r.n_modified, r.n_deleted, r.n_unchanged) for r in done.decision.collect()}
    assert counts == {"web": (2, 2, 2, 8), "docx": (2, 1, 1, 7)}
    journal = spark.read.parquet(f"{store.path}/journal").groupBy("status").count()
    assert {r.status: r["count"] for r in journal.collect()} == {"added": 21 + 4, "modified": 3, "deleted": 3}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = built(spark, tmp_path, "a", *FIRST)
    before = store.chunks.files()
    pages, texts = FIRST
    done = corpus.merge_refresh(*inputs(spark, [page(0, "Tout autre contenu de texte")] + pages[1:], texts), store, DAY)
    after = store.chunks.files()
    assert len(done.touched) == 1 and {k for k in after if after[k] != before.get(k)} == set(done.touched)
    again = corpus.merge_refresh(*inputs(spark, [page(0, "Tout autre contenu de texte")] + pages[1:], texts), store, DAY)
    assert again.touched == [] and store.chunks.files() == after and store.damaged() == []
    assert all(r.n_added + r.n_modified + r.n_deleted + r.n_chunks == 0 for r in again.decision.collect())


def test_everything_deleted(spark, tmp_path):
    store = built(spark, tmp_path, "a", *FIRST)
    corpus.merge_refresh(*inputs(spark, FIRST[0], []), store, DAY)
    assert {r.source_type for r in store.chunks.rows().collect()} == {"web"}
    corpus.merge_refresh(*inputs(spark, [], []), store, DAY)
    assert store.chunks.rows().count() == store.sources.rows().count() == 0 and store.chunks.files() == {}
    corpus.merge_refresh(*inputs(spark, *FIRST), store, DAY)
    assert chunks(store) == chunks(built(spark, tmp_path, "b", *FIRST))


@pytest.mark.parametrize("stop", ["chunks", "journal", "sources"])
def test_interrupted_refresh_is_repeated(spark, tmp_path, monkeypatch, stop):
    store = built(spark, tmp_path, "a", *FIRST)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if stop == "journal":
            m.setattr(corpus.sinks, "append_changes", fail)
        else:
            m.setattr(getattr(store, stop), "merge", fail)
        with pytest.raises(RuntimeError):
            corpus.merge_refresh(*inputs(spark, *LATER), store, DAY)
    corpus.merge_refresh(*inputs(spark, *LATER), store, DAY)
    assert chunks(store) == chunks(built(spark, tmp_path, "b", *LATER)) and store.damaged() == []


def test_lost_bucket_is_built_again(spark, tmp_path):
    store = built(spark, tmp_path, "a", *FIRST)
    want, place = chunks(store), sorted(store.chunks.files())[0]
    store.chunks._fs.delete(store.chunks._folder(place), True)
    assert store.damaged() == [place] and chunks(store) != want
    done = corpus.merge_refresh(*inputs(spark, *FIRST), store, DAY)
    assert chunks(store) == want and done.touched == [place]


def test_repeated_urls_are_one_source(spark, tmp_path):
    twice = [page(1, "Un texte assez long"), page(1, "Un second texte assez long")]
    store = built(spark, tmp_path, "a", twice, [])
    n = store.chunks.rows().count()
    assert n > 0 and store.damaged() == []
    done = corpus.merge_refresh(*inputs(spark, twice[::-1], []), store, DAY)
    assert done.touched == []
    corpus.merge_refresh(*inputs(spark, twice[:1], []), store, DAY)
    assert 0 < store.chunks.rows().count() < n


def test_bucket_number_is_checked(spark, tmp_path):
    built(spark, tmp_path, "a", *FIRST)
    with pytest.raises(ValueError):
        corpus.ChunkStore(spark, str(tmp_path / "a"), 2)


def test_merge_reads_only_touched_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k string, v int", "k", 16)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int")
    table.merge(rows.select("k"), rows)
    read = table.rows().where(table._within([(3,), (4,)]))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and {r.bucket for r in read.collect()} == {3, 4}
