import base64
import gzip
import json

from pyspark.sql import functions as F
from threadlake.sources import files


def test_project_files(spark, tmp_path):
    for path, text in {"a.py": "x", "src/b.ts": "y", "node_modules/c.js": "n", "src/pic.PNG": "n", "src/build/d.py": "n", "1/2/3/4/5/6/e.md": "deep", "1/2/3/4/5/6/7/f.md": "n", "big.txt": "z" * 300}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = files.project_files(spark, str(tmp_path), max_bytes=200).orderBy("path").collect()
    assert [(r.path, r.text) for r in got] == [("1/2/3/4/5/6/e.md", "deep"), ("a.py", "x"), ("src/b.ts", "y")]


def test_bundles(spark):
    sessions = [{"id": "s1", "messages": [{"role": "user", "content": "é"}]}, {"id": "s2", "messages": []}, 5, {"messages": []}]
    good = base64.b64encode(gzip.compress(json.dumps(sessions).encode())).decode()
    rows = [(good,), ("no base64!",), (base64.b64encode(b"no gzip").decode(),), (None,), (base64.b64encode(gzip.compress(b"{broken")).decode(),)]
    got = files.bundled_sessions(spark.createDataFrame(rows, "data string")).orderBy("session_id").collect()
    assert [(r.session_id, [m.content for m in r.messages]) for r in got] == [("s1", ["é"]), ("s2", [])]


def test_landed_and_exported(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id":"a","platform":"p","messages":[{"role":"user","content":"x"}]}\n{broken\n')
    got = files.landed_sessions(spark, str(tmp_path / "in.json")).cache()
    assert got.filter("broken IS NULL").count() == 1 and got.filter("broken IS NOT NULL").count() == 1
    files.write_metrics(spark.range(10).withColumnRenamed("id", "at_s"), str(tmp_path / "out"), 6)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_fences_and_entities(spark):
    page = '<div>a<br>b &amp;lt; c</div><script>x</script><pre class="y"><code class="language-py">x = 1 &lt; 2</code></pre><p>end</p><!-- no -->'
    assert spark.range(1).select(files.html_text(F.lit(page)).alias("t")).first().t == "a\nb &lt; c\n\n```py\nx = 1 < 2\n```\n\nend"
