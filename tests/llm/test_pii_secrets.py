from quandrel.llm import pii


def test_whole_secrets_are_replaced(spark):
    long = "aB3" * 70
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"
    texts = [f"password={long} end", f"token={jwt}. Next", "api_key = abcd~efgh=ijkl== !"]
    got = [r.text for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert [len(x) for x in got] == [len(x) for x in texts]
    for new, old in zip(got, texts, strict=True):
        assert new.split("=")[0] == old.split("=")[0] and new.split()[-1] == old.split()[-1]
    assert long[-60:] not in got[0] and not any(x in got[1] for x in jwt.split(".")) and "ijkl" not in got[2]
