"""A file that holds all notices gets all their labels."""

from skyweft.llm import license_scan


def test_all_notices_in_one_file(spark):
    notices = [text for _, text, _ in license_scan.TEMPLATES]
    rows = [(0, " and so on ".join(notices)), (1, ". ".join(reversed(notices)).upper()), *((2 + i, x) for i, x in enumerate(notices))]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {label for label, _, _ in license_scan.TEMPLATES}
    for i in (0, 1):
        assert wanted <= set(found[i].labels.split(",")) and found[i].score == 1
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[2 + i].labels.split(",")
