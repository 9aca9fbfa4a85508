"""Steps that several operators read are made once."""

from strandline.plans import catalog  # noqa: F401
from strandline.plans.template import REGISTRY, build

FOLDER = "/root/testdata/sf0.001"


def test_steps_of_note_scores_are_tables(spark):
    for name in ("acts", "contacts", "lang_tags", "thr_edges", "note_addresses", "reply_votes", "short_phrases", "reply_piles", "disc_note_score"):
        found = build(spark, FOLDER, name)
        assert found.inputFiles() and all("/cut-" in f for f in found.inputFiles()), name
        assert build(spark, FOLDER, name) is found
        assert found.columns == REGISTRY[name](**{k: build(spark, FOLDER, k) for k in REGISTRY[name].inputs}).columns


def test_summaries_and_profile_windows_are_tables(spark):
    for name in ("thr_summary", "disc_profile_windows", "disc_profile_score"):
        found = build(spark, FOLDER, name)
        assert found.inputFiles() and all("/cut-" in f for f in found.inputFiles()), name


def test_newest_profiles_are_a_table(spark):
    found = build(spark, FOLDER, "state_profiles_latest")
    assert found.inputFiles() and all("/cut-" in f for f in found.inputFiles())


def test_frames_that_are_given_are_not_kept_for_a_folder(spark):
    acts = build(spark, FOLDER, "acts").limit(0)
    assert build(spark, FOLDER, "cnt_replies", {"acts": acts}).isEmpty()
    assert not build(spark, FOLDER, "cnt_replies").isEmpty()
