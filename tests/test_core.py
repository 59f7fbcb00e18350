"""Search, hierarchy, catalogue, change data, snapshots and functions on small fixtures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import names as N
from lodestone.functions import text as X
from lodestone.operators import catalogue, hierarchy, search
from lodestone.sources import tables, versions
from lodestone.streaming import changes, log_state


def records(spark, rows, drive="C"):
    return spark.createDataFrame([(drive, *r) for r in rows], tables.SCAN)


def one(spark, make, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(make).collect()]


@pytest.fixture(scope="module")
def ranked(spark):
    return hierarchy.with_ancestry(
        records(
            spark,
            [(40, 0, "Users", True), (30, 0, "node_modules", True), (1, 40, "Report.pdf", False), (2, 0, "report.txt", False), (3, 0, "report_final.docx", False), (4, 0, "deptreport.pdf", False), (5, 30, "report.js", False)],
        )
    )


def names_of(frame):
    return [r["name"] for r in frame.collect()]


def test_ranking(ranked):
    page, total = search.search_paged(ranked, "report", 10)
    assert names_of(page) == ["Report.pdf", "report.txt", "report_final.docx", "deptreport.pdf"] and total == 4
    assert [r["rank"] for r in page.collect()] == [2, 2, 2, 4]
    assert names_of(search.search_generic(ranked, "Report", case_sensitive=True)) == ["Report.pdf"]
    assert search.search_paged(ranked, "")[1] == 0
    assert names_of(search.search_line(ranked, "folder:node_modules")) == ["node_modules"]
    assert names_of(search.search_line(ranked, "*.pdf")) == ["deptreport.pdf", "Report.pdf"]


def test_fuzzy_score(spark):
    def plain(name, q):
        at, score, before = -1, 0, -2
        for c in q:
            at = name.find(c, at + 1)
            if at < 0:
                return -1
            score += 4 if at == 0 or name[at - 1] in " -_.([" else 3 if at == before + 1 else max(0, 3 - at + before)
            before = at
        return score

    rng = random.Random(5)
    names = ["".join(rng.choice("ab -_c") for _ in range(rng.randint(0, 9))) for _ in range(200)] + [None]
    for q in ("ab", "abc", "a b", "bb", "ca"):
        assert one(spark, X.fuzzy_score(F.col("a"), q), [(n,) for n in names]) == [plain(n or "", q) for n in names]
    assert one(spark, X.fuzzy_score(F.col("a"), "a"), [("a",)]) == [-1]


def test_fuzzy(spark):
    rows = hierarchy.with_ancestry(records(spark, [(1, 0, "Visual Studio Code.lnk", False), (2, 0, "visualstudio.exe", False), (3, 0, "Vim.exe", False), (4, 0, "somethingelse.txt", False)]))
    assert names_of(search.search_paged(rows, "vsc")[0]) == ["Visual Studio Code.lnk"]
    assert set(names_of(search.search_paged(rows, "vis")[0])[:2]) == {"Visual Studio Code.lnk", "visualstudio.exe"}


def test_extension_ranking(spark):
    rows = hierarchy.with_ancestry(records(spark, [(40, 0, "Users", True), (50, 40, "Projects", True), (1, 40, "tree.py", False), (2, 50, "forest.py", False), (3, 40, "stem.py", False), (4, 0, "root.py", False)]))
    found = names_of(search.search_paged(rows, ".py")[0])
    assert set(found[:2]) == {"tree.py", "stem.py"} and found[2:] == ["forest.py", "root.py"]
    assert names_of(search.search_paged(rows, ".py", excluded=("c:\\users\\",))[0]) == ["root.py"]
    placed = {r["file_ref"]: (r["depth"], r["user_path"]) for r in rows.collect()}
    assert placed[1] == (1, 1) and placed[2] == (2, 1) and placed[4] == (1, 0)
    prefixes = spark.createDataFrame([("C:\\Users\\Projects\\",), ("C:\\Users\\Projects\\",), (None,)], "prefix string")
    assert set(names_of(search.without_prefixes(rows, prefixes))) == {"Users", "Projects", "tree.py", "stem.py", "root.py"}


def test_extension_paging(spark):
    rows = hierarchy.with_ancestry(records(spark, [(40, 0, "Users", True), *((1000 + k, 40, f"mod_{k:03}.py", False) for k in range(300)), (99, 40, "notes.txt", False)]))
    pages = [names_of(search.search_extension(rows, "py", 100, skip)) for skip in (0, 100, 200)]
    assert len({n for p in pages for n in p}) == 300 and search.search_paged(rows, "py", 10)[1] == 300 and search.search_paged(rows, ".txt")[1] == 1


def test_dot_names(spark):
    rows = hierarchy.with_ancestry(records(spark, [(40, 0, "Users", True), (1, 40, "setup.py", False), (2, 40, "PyGame.py", False), (3, 40, ".pyproject", False), (4, 40, "init.py", False), (5, 40, ".config", True), (6, 40, "web.config", False), (7, 40, ".gitignore", False), (8, 40, "end.", False)]))
    assert search.search_paged(rows, ".py")[1] == 3 and names_of(search.search_paged(rows, "py")[0])[0] == "PyGame.py"
    page, total = search.search_paged(rows, ".config")
    assert total == 2 and names_of(page)[0] == ".config"
    page, total = search.search_paged(rows, ".gitignore")
    assert total >= 1 and names_of(page)[0] == ".gitignore"


def test_prune_and_depth(spark):
    entries, refs = hierarchy.prune(records(spark, [(1, 0, "Users", True), (10, 1, "Alice", True), (11, 10, "report.txt", False), (12, 10, "photo.PNG", False), (13, 0, "node_modules", True), (14, 13, "lodash.js", False), (15, 0, "Temp", True), (16, 15, "cache.tmp", False)]))
    assert entries.count() == 6 and {r["file_ref"] for r in refs.collect()} == {14, 16}
    deep = hierarchy.with_ancestry(records(spark, [(5, 5, "", True), (1, 5, "Users", True), (10, 1, "Alice", True), (11, 10, "report.txt", False), (20, 5, "dev", True), (21, 20, "deep", True), (22, 21, "root_like.py", False), (30, 50, "orphan.txt", False)]))
    got = {r["name"]: (r["depth"], r["user_path"], r["path"]) for r in deep.collect()}
    assert got["report.txt"] == (3, 1, "C:\\Users\\Alice\\report.txt") and got["Users"][:2] == (1, 1) and got["root_like.py"][:2] == (3, 0) and got["orphan.txt"][:2] == (1, 0)


def test_two_drives_cycles_and_long_chains(spark):
    both = records(spark, [(1, 0, "Users", True), (10, 1, "a.txt", False)]).union(records(spark, [(1, 0, "Games", True), (10, 1, "b.exe", False)], "D"))
    roots = spark.createDataFrame([("C", "C:\\"), ("D", "D:\\")], "drive string, root string")
    assert {r["path"] for r in hierarchy.with_ancestry(both, roots).where("not is_dir").collect()} == {"C:\\Users\\a.txt", "D:\\Games\\b.exe"}
    chain = [(k, k - 1, f"d{k}", True) for k in range(1, 31)] + [(100, 30, "leaf", False), (201, 202, "x", True), (202, 201, "y", True), (203, 202, "z", False)]
    got = {r["name"]: r for r in hierarchy.with_ancestry(records(spark, chain)).collect()}
    assert got["leaf"]["depth"] == 15 and got["leaf"]["path"] == "C:\\" + "".join(f"d{k}\\" for k in range(1, 31)) + "leaf" and 1 <= got["z"]["depth"] <= 15
    assert hierarchy.with_ancestry(records(spark, [])).count() == 0


def test_word_prefix(spark):
    cases = [("xa-a-a", "a-a"), ("foo-bar", "bar"), ("foobar", "bar"), ("é-bar", "bar"), ("a.b.b", ".b"), ("--x", "-"), ("foo (bar)", "(bar"), ("abc", "")]

    def plain(name, q):
        if not q:
            return True
        at = 0
        while (k := name.find(q, at)) >= 0:
            if k == 0 or not (name[k - 1].isascii() and name[k - 1].isalnum()):
                return True
            at = k + len(q)
        return False

    for name, q in cases:
        assert one(spark, N.word_prefix(F.col("a"), q), [(name,)]) == [plain(name, q)], (name, q)


def test_name_predicates(spark):
    assert one(spark, N.normalized_app_name(F.col("a")), [("Antigravity 2.1.4",), ("Opera Stable 133.0.5932.85",), ("Opera Browser",), ("Python 3.13 (64-bit)",), ("PowerShell (x86)",), ("Snipping Tool - Shortcut",), ("Office 2012",), ("Code (User)",)]) == ["antigravity", "opera", "opera", "python", "powershellx86", "snippingtool", "office2012", "code"]
    assert one(spark, N.launchable(F.col("a")), [("C:\\x.exe",), ("\\\\srv\\x",), ("\\\\.\\x",), ("aumid:q",), ("ms-settings:",), ("x.exe",)]) == [True, True, False, True, True, False]
    assert one(spark, N.uninstaller_allowed(F.col("a")), [("C:\\a\\unins000.exe",), ("cmd.exe",), ("C:\\w\\PowerShell.EXE",), ("msiexec.exe",), ("setup.exe",)]) == [True, False, False, True, False]
    assert one(spark, N.shortcut_junk(F.col("a")), [("C:\\x\\cmd.exe",), ("http://a",), ("C:\\x\\a.HTML",), ("C:\\x\\unins000.exe",), ("C:\\x\\app.exe",)]) == [True, True, True, True, False]
    assert one(spark, N.installer_junk(F.col("a")), [("C:\\ProgramData\\Package Cache\\x.exe",), ("C:\\uninst.exe",), ("C:\\a.exe",)]) == [True, True, False]
    assert one(spark, N.shell_junk(F.col("a"), F.col("a")), [("aumid:http://x",), ("Uninstall me",), ("VS Command Prompt",), ("Word",)]) == [True, True, True, False]
    assert one(spark, N.image_name(F.col("a")), [("C:\\a.PNG",), ("C:\\a.png:s.png",), ("png",), ("a.txt",)]) == [True, False, False, False]
    assert one(spark, N.extension_priority(F.col("a")), [("a.py",), ("a.mp4",), ("a.7z",), ("a.q",), ("zip",)]) == [0, 1, 2, 3, 2]


def test_text_functions(spark):
    import pyarrow as pa

    cases = {
        "-2^2": "-4", "2^3^2": "512", "1+2*3": "7", "(1+2)*3/4": "2.25", "7%4": "3", "-7%4": "-3", "1/3": "0.333333333", "0.1+0.2": "0.3", "5/0": None, "5": None, "1+": None, "2**3": None, "1e5+1": None, "-0*1": "0", "3-3": "0",
        "2^-1^2": "0.5", "2*-3": "-6", "--3": "3", "-(2+3)^2": "-25", "1 2+3": None, "(1+2": None, "1+2)": None, "()+1": None, ".5+1.": "1.5", "1.2.3+1": None, "(-8)^(1/3)": None, "10^20*1": "100000000000000000000", "10^21*1": "1e+21", "1/(1/0)": "0", "2^0.5": "1.414213562", "": None, " 6 / 4 ": "1.5", "1" * 77 + "+1": "1.1111111111111111e+76", "1" * 80 + "+1": None, None: None,
    }
    assert dict(zip(cases, X.evaluated(pa.array(list(cases), pa.string())), strict=True)) == cases
    assert X.evaluated(pa.array([], pa.string())) == [] and X.evaluated(pa.array([None], pa.string())) == [None]
    env = {"Name": "v", "Home": "%x", "A": "1%B%2", "b": "%name%%c%", "C": "z", "half": "50%", "self": "<%self%>"}
    cases = {"%NAME%\\a": "v\\a", "%no%b": "no%b", "a%%b": "a%b", "50%": "50%", "%name%%name%": "vv", "%A%": "1vz2", "x%a%%a%%": "x1vz21vz2%", "%half% of%": "50 of%", "%home%name%": "xname%", "": "", "%no%name%": "nov"}
    assert one(spark, X.expand_env(env)(F.col("a")), [(c,) for c in cases]) == list(cases.values())
    assert one(spark, X.expand_env(env)(F.col("a")), [(None,), ("%self%",)])[0] is None and one(spark, X.expand_env({})(F.col("a")), [("%a%",)]) == ["a%"]
    pretty = {"visual_studio-code's": "VisualStudioCode's", "'abc": "'Abc", "---": "---", "\u00fcber": "Ber", "a''b'-'c": "A''b''C", "": "", "x1 2y": "X12y", "\u00e9": "\u00e9"}
    assert one(spark, X.prettified(F.col("a")), [(c,) for c in pretty]) == list(pretty.values())
    got = one(spark, X.uninstall_command(F.col("a")), [('"C:\\a b\\u.exe" /S x',), ("u.exe  /q",), ('"open end',), ("",), ('"a\\"b" c',)])
    assert [g and tuple(g) for g in got] == [("C:\\a b\\u.exe", "/S x"), ("u.exe", "/q"), ("open end", ""), None, ('a"b', "c")]
    assert one(spark, X.format_size(F.col("a")), [(5,), (1536,), (5 << 20,), (3 << 30,)], "a long") == ["5 B", "1.5 KB", "5.0 MB", "3.00 GB"]
    assert one(spark, X.unescape_xml(F.col("a")), [("&amp;lt; &lt;é&quot;",)]) == ['&lt; <é"']
    assert one(spark, X.strip_html(F.col("a")), [("<b>x</b>  y<i",), ("z" * 300,), ("é" * 150,), ("z" + "é" * 150,)]) == ["x y", "z" * 200 + "…", "é" * 100 + "…", "z" + "é" * 99 + "…"]
    rss = "<item><title>A &amp; B</title><link>u</link><description>&lt;p&gt;hi</description></item><item><title></title><link>v</link></item>" + "<item><title>t</title><link>w</link></item>" * 9
    found = one(spark, X.rss_items(F.col("a")), [(rss,)])[0]
    assert len(found) == 5 and tuple(found[0]) == ("A & B", "u", "hi")
    answer = '{"Heading": "H", "AbstractText": "abs", "AbstractURL": "u0", "RelatedTopics": [{"Text": "t1", "FirstURL": "u1"}, {"Name": "n", "Topics": [{"Text": "t2", "FirstURL": "u2"}]}]}'
    assert [r["url"] for r in one(spark, X.answer_results(F.col("a")), [(answer,)])[0]] == ["u0", "u1", "u2"]
    assert one(spark, X.search_url(F.col("a")), [("a b",), ("x.com",), ("https://q",), (" ",)]) == ["https://www.google.com/search?q=a+b", "https://x.com", "https://q", None]
    assert one(spark, search.highlights(F.col("a"), "ab"), [("xAbabab-ab",)])[0] == [(1, 2), (3, 2), (5, 2)]
    assert one(spark, X.math_tokens(F.col("a")), [("100*2 /x",)]) == [["100", "×", "2", "÷", "x"]]
    assert search.expand_path('"~\\a"', {}, "C:\\Users\\me") == "C:\\Users\\me\\a" and search.expand_path("%no%\\a", {}, "C:\\h") is None and search.expand_path("docs\\a", {}, "C:\\h", {"docs": "D:\\docs"}) == "D:\\docs\\a"


def test_catalogue(spark):
    rows = spark.createDataFrame(
        [(0, 0, "Microsoft Word", "aumid:word"), (1, 0, "Word 16.0", "C:\\s\\Word.lnk"), (1, 1, "winword", "C:\\o\\WINWORD.EXE"), (2, 0, "Opera Stable 1.2", "C:\\op.exe"), (2, 1, "OPERA", "C:\\op2.exe"), (2, 2, "Bad", "relative.exe"), (2, 3, None, None)],
        "src_prio int, ordinal int, name string, path string",
    )
    links = spark.createDataFrame([("C:\\s\\Word.lnk", "C:\\o\\winword.exe")], "path string, target string")
    assert names_of(catalogue.discover(rows, links)) == ["Microsoft Word", "Opera Stable 1.2", "Word 16.0"]
    sources = spark.createDataFrame([(0, 0, "App", "p0", None, None), (1, 0, "APP", "p1", "loc", None), (2, 0, "app", "p2", "loc2", "ico")], "src_prio int, ordinal int, name string, publisher string, install_location string, icon string")
    row = catalogue.coalesced(sources, ("install_location", "icon")).first()
    assert (row["publisher"], row["install_location"], row["icon"]) == ("p0", "loc", "ico")
    best = catalogue.best_executable(spark.createDataFrame([("My App", "C:\\x\\helper.exe", 0), ("My App", "C:\\x\\myapp.exe", 1), ("My App", "C:\\x\\myapp2.exe", 2), ("No", "C:\\q.exe", 0)], "app string, path string, ordinal int"))
    assert [tuple(r) for r in best.collect()] == [("My App", "C:\\x\\myapp.exe")]
    apps = spark.createDataFrame([("Settings: A", "a"), ("Word", "b"), ("WordPad", "c"), ("My Word", "d")], "name string, path string")
    freq = spark.createDataFrame([("c", 9)], "path_lower string, cnt long")
    assert names_of(search.app_search(apps, freq, "word")) == ["Word", "WordPad", "My Word"] and names_of(search.app_search(apps, freq, ""))[0] == "WordPad"


def test_target_graph(spark):
    """The graph of targets: three pairs that it has to tell apart, and random catalogues in any order against a search of components."""
    import itertools

    def found(rows, links=(), aliases=None):
        apps = spark.createDataFrame([(n, p, 1, k) for k, (n, p) in enumerate(rows)], "name string, path string, src_prio int, ordinal int")
        links = spark.createDataFrame(list(links), "path string, target string")
        aliases = aliases and spark.createDataFrame(aliases, "path string, canonical string")
        return sorted(names_of(catalogue.one_of_target(catalogue.with_target(apps, links, aliases))))

    word = [("Microsoft Word", "aumid:Microsoft.Office.WINWORD.EXE.15"), ("WINWORD", "C:\\s\\w.lnk")]
    assert found(word, [("C:\\s\\w.lnk", "C:\\o\\WINWORD.EXE")]) == ["Microsoft Word"]
    assert found([("Some App", "aumid:C:\\x\\app.exe"), ("app", "C:\\x\\app.exe")]) == ["Some App"]
    folder = "aumid:{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\notepad.exe"
    assert found([("Notepad", folder), ("notepad", "D:\\tools\\notepad.exe")]) == ["Notepad", "notepad"]
    assert found([("Notepad", folder), ("notepad", "c:/windows/./system32/x/../notepad.exe")]) == ["Notepad"]
    # two channels of one file name stay two, with a Store id, too, whatever the order
    channels = [("Chrome", "C:\\a\\chrome.exe"), ("Chrome Beta", "C:\\b\\chrome.exe"), ("Google Chrome", "aumid:Google.chrome.exe.1")]
    for rows in itertools.permutations(channels):
        assert len(found(rows)) == 2
    assert found([("Long", "C:\\Progra~1\\x.exe"), ("long name", "C:\\Program Files\\x.exe")], aliases=[("C:\\PROGRA~1\\X.EXE", "C:\\Program Files\\x.exe")]) == ["Long"]
    assert found([("a", "ms-settings:x"), ("b", "ms-settings:y"), ("c", "aumid:plain!App"), ("d", "C:\\no.lnk")]) == ["a", "b", "c", "d"]
    tokens = one(spark, X.package_exe(F.col("a")), [("Microsoft.Office.WINWORD.EXE.15",), ("a!b.exe.1",), ("x.a!b.exe.c.exe.d",), ("plain",), (".exe.",), ("x_1-a.exe",)])
    assert tokens == ["winword", None, "c", None, None, "x_1-a"]
    paths = one(spark, N.canonical_path(F.col("a")), [(" C:\\A\\..\\b//.\\C.exe ",), ("\\\\srv\\x\\..\\y",), ("C:\\..\\..\\a",), ("a/b/../../c",), (None,), ("",)])
    assert paths == ["c:\\b\\c.exe", "\\\\srv\\y", "c:\\a", "a\\c", None, ""]

    rng = random.Random(21)
    for _ in range(6):
        rows, keys = [], []
        for k in range(40):
            exe, folder = rng.choice(["a.exe", "b.exe", "c.exe", "d.exe"]), rng.choice("xyz")
            path, target, store = rng.choice([(f"C:\\{folder}\\{exe}", f"c:\\{folder}\\{exe}", None), (f"aumid:c:\\{folder}\\{exe}", f"c:\\{folder}\\{exe}", None), (f"aumid:V.{exe}.{folder}", None, exe), (f"aumid:{exe}!{k}", None, None)])
            rows.append((f"{rng.choice(['App', 'APP', 'app x'])}{k}", path, rng.randint(0, 2), k))
            keys.append((target, store))
        order = sorted(range(40), key=lambda k: rows[k][2:])
        group = {}
        for k, (target, store) in enumerate(keys):
            first = next((keys[j][0] for j in order if keys[j][0] and keys[j][0].endswith("\\" + store)), store) if store else None
            group.setdefault(target or first or rows[k][1].lower(), []).append(k)
        scores = [r["s"] for r in spark.createDataFrame([(r[3], r[0], r[1], t) for r, (t, _) in zip(rows, keys, strict=True)], "k int, name string, path string, target string").select("k", N.app_name_score(F.col("name"), F.col("path"), F.col("target")).alias("s")).orderBy("k").collect()]
        expected = sorted(rows[min(g, key=lambda k: (-scores[k], *rows[k][2:]))][0] for g in group.values())
        rng.shuffle(rows)
        apps = spark.createDataFrame(rows, "name string, path string, src_prio int, ordinal int")
        assert sorted(names_of(catalogue.one_of_target(catalogue.with_target(apps, spark.createDataFrame([], "path string, target string"))))) == expected


def test_executables(spark):
    apps = spark.createDataFrame(
        [
            ("My App", '"C:\\a\\myapp.exe",0', None, None, None), ("Beside", "C:\\b\\icon.ico", None, None, None), ("Located", None, "C:\\l\\", '"C:\\a\\myapp.exe"', None),
            ("Gone", None, "C:\\nowhere", '"C:\\a\\myapp.exe"', None), ("Unin", None, None, '"C:\\u\\unins000.exe" /S', None), ("Msi", None, None, "MsiExec.exe /X{1}", "C:\\m\\msi.exe /q"), ("None", None, None, None, None),
        ],
        "app string, icon string, install_location string, uninstall_string string, quiet_uninstall_string string",
    )
    files = ["C:\\a\\MyApp.exe", "C:\\b\\icon.ico", "C:\\b\\beside.exe", "C:\\b\\other.exe", "C:\\l\\located2.exe", "C:\\l\\located.exe", "C:\\u\\unins000.exe", "C:\\u\\unin.exe", "C:\\m\\msi.exe"]
    found = catalogue.executables(apps, spark.createDataFrame([(f, k) for k, f in enumerate(files)], "path string, ordinal int"))
    assert {r["app"]: r["path"] for r in found.collect()} == {"My App": "C:\\a\\MyApp.exe", "Beside": "C:\\b\\beside.exe", "Located": "C:\\l\\located.exe", "Unin": "C:\\u\\unin.exe", "Msi": "C:\\m\\msi.exe"}


def joins_of(frame):
    """(rows, condition) of each join of a collected frame's plan; condition: what is tested for each pair of rows with equal keys."""
    found, left = [], [frame._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(plan.plan())
        if "Join" in name:
            found.append((plan.metrics().apply("numOutputRows").value(), plan.condition().toString()))
        children = plan.children()
        left += [children.apply(k) for k in range(children.size())]
    return found


def test_executables_of_one_folder_do_not_meet_all_files(spark):
    """All applications and files of one folder: what every pair would give, from joins whose rows grow with the tables."""
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("aB é") for _ in range(rng.randint(0, most)))
    apps = [(word(5) + word(2), rng.choice("xy")) for _ in range(150)] + [(None, "x"), ("", "x"), (" ", "y"), ("aB" * 40, "y")]
    files = sorted({(f"C:\\{rng.choice('xy')}\\{word(4)}.exe", rng.randint(0, 9) * 1000 + k) for k in range(100)})
    expected = {}
    low = {}
    for path, ordinal in sorted(files, key=lambda f: f[1]):
        low.setdefault(path.lower(), (path, ordinal))
    for app, home in apps:
        compact = None if app is None else app.lower().replace(" ", "")
        for path, ordinal in low.values():
            name = path.lower().rpartition("\\")[2][:-4]
            if compact is not None and path.startswith(f"C:\\{home}\\") and (name in compact or compact in name):
                expected[app] = min(expected.get(app, (0, 0, "")), (-100 if name == compact else -50, ordinal, path))
    sources = spark.createDataFrame([(a, None, f"C:\\{h}\\", None, None) for a, h in apps], "app string, icon string, install_location string, uninstall_string string, quiet_uninstall_string string")
    found = catalogue.executables(sources, spark.createDataFrame(files, "path string, ordinal long"))
    assert {r["app"]: r["path"] for r in found.collect()} == {a: f[2] for a, f in expected.items()}

    n = 1_500
    apps = spark.range(n).selectExpr("concat('Tool ', 100000 + id) as app", "cast(null as string) as icon", "'C:\\\\t' as install_location", "cast(null as string) as uninstall_string", "cast(null as string) as quiet_uninstall_string")
    found = catalogue.executables(apps, spark.range(n).selectExpr("concat('C:\\\\t\\\\tool', 100000 + id, '.exe') as path", "id as ordinal"))
    assert len(found.collect()) == n
    assert (joins := joins_of(found)) and all(rows < 100 * n and "Contains(" not in condition for rows, condition in joins), joins


def test_path_search(spark):
    rows = hierarchy.with_ancestry(records(spark, [(1, 0, "Users", True), (2, 1, "Alice", True), (3, 2, "notes.txt", False), (4, 2, "note", True), (5, 4, "deep", True), (6, 5, "footnote.md", False)]))
    paths = lambda p: [r["path"] for r in search.path_search(rows, p).collect()]
    assert paths("c:\\users\\ALICE\\") == ["C:\\Users\\Alice"] and paths("C:\\Users\\Alice\\notes.txt") == ["C:\\Users\\Alice\\notes.txt"]
    assert paths("C:\\Users\\Alice\\gone\\note") == ["C:\\Users\\Alice\\note", "C:\\Users\\Alice\\notes.txt", "C:\\Users\\Alice\\note\\deep\\footnote.md"]
    assert paths("C:\\Users\\Alice\\notes.txt\\x") == [] and paths("C:\\nothing") == []


def test_with_previous(spark):
    from lodestone.operators.ordered import with_previous

    rows = [(("a", "b", None)[k % 3], k * 7 - 50, f"v{k}") for k in range(60)]
    found = {(r["k"], r["o"]): r["p"] for r in with_previous(spark.createDataFrame(rows, "k string, o long, v string"), "k", "o", "v", "p", width=10).collect()}
    assert found == {(k, o): next((v for kk, oo, v in reversed(rows) if kk == k and oo < o), None) for k, o, _ in rows}


def test_with_previous_over_sparse_orders(spark):
    """Time stamps, both ends of a long, dense stretches, null values and null orders; ranges of ranges, each window of `width` rows at most."""
    from lodestone.operators.ordered import with_previous

    rng = random.Random(9)
    orders = {rng.randrange(-(1 << 62), 1 << 62) for _ in range(200)} | {1_700_000_000_000_000 + rng.randrange(10**6) for _ in range(200)} | set(range(-40, 40)) | {-(1 << 63), (1 << 63) - 1}
    rows = sorted((o, rng.choice(("a", "a", "b", None)), rng.choice((f"v{o}", f"v{o}", None))) for o in orders)
    frame = spark.createDataFrame([(k, o, v) for o, k, v in rows] + [("a", None, "x"), ("c", None, "y")], "k string, o long, v string")
    for width in (16, 4096):
        found = with_previous(frame, "k", "o", "v", "p", width=width)
        assert found.columns == ["k", "o", "v", "p"]
        expected, last = {("a", None): None, ("c", None): None}, {}
        for o, k, v in rows:
            expected[k, o], last[k] = last.get(k), v
        got = [((r["k"], r["o"]), r["p"]) for r in found.collect()]
        assert len(got) == len(rows) + 2 and dict(got) == expected
    assert with_previous(frame.where("false"), "k", "o", "v", "p").count() == 0


def event(seq, op, ref, name="n", parent=0, old=None, drive="C", is_dir=False):
    return (drive, seq, op, ref, old, parent, name, is_dir)


def refs(state):
    return {(r["drive"], r["file_ref"]) for r in changes.live(state).collect()}


def test_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, tables.EVENTS)
    empty = spark.createDataFrame([], changes.STATE)
    a, b = [event(1, "created", 42), event(2, "deleted", 42), event(3, "created", 7)], [event(4, "deleted", 7), event(5, "created", 8)]
    for order in ((a, b), (b, a), (b, a, b)):
        state = empty
        for batch in order:
            state = changes.merged(state, make(batch))
        assert refs(state) == {("C", 8)}
    state = changes.from_scan(records(spark, [(10, 1, "Alice", True), (11, 10, "r.txt", False)]))
    state = changes.merged(state, make([event(1, "renamed", 12, "Bob", 1, 10, is_dir=True), event(2, "moved", 11, "r2.txt", 12), event(3, "checkpoint", 0), event(1, "created", 10, drive="D")]))
    assert {(r["drive"], r["file_ref"], r["name"]) for r in changes.live(state).collect()} == {("C", 12, "Bob"), ("C", 11, "r2.txt"), ("D", 10, "n")}
    journal = spark.createDataFrame([("C", 1, 5, 0, "x", False, 0x300), ("C", 2, 6, 0, "y", False, 0x2100), ("C", 3, 7, 0, "z", False, 0x1000), ("C", 4, 8, 0, "", False, 0x100)], "drive string, seq long, file_ref long, parent_ref long, name string, is_dir boolean, reason int")
    assert [r["op"] for r in changes.journal_events(journal).orderBy("seq").collect()] == ["deleted", "moved"]
    drives = spark.createDataFrame([("C", 1, 5, 50), ("D", 1, 5, 50), ("E", 2, 5, 50), ("F", 1, 5, 50)], "drive string, journal_id long, first_seq long, next_seq long")
    seen = spark.createDataFrame([("C", 1, 20), ("D", 1, 2), ("E", 1, 20)], tables.CHECKPOINTS)
    assert {r["drive"]: r["rescan"] for r in changes.rescans(drives, seen).collect()} == {"C": False, "D": True, "E": True, "F": True}


def test_random_changes(spark):
    rng, model, batches, seq = random.Random(8), {}, [], 0
    for _ in range(12):
        batch = []
        for _ in range(rng.randint(1, 30)):
            seq += 1
            drive, ref, op, name = rng.choice("CD"), rng.randint(1, 20), rng.choice(["created", "deleted", "moved", "renamed"]), f"n{rng.randint(0, 6)}"
            old = rng.randint(1, 20) if op == "renamed" else None
            batch.append(event(seq, op, ref, name, old=old, drive=drive))
            if old is not None and old != ref:
                model.pop((drive, old), None)
            model.pop((drive, ref), None)
            if op != "deleted":
                model[drive, ref] = name
        batches.append(batch)
    rng.shuffle(batches)
    state = spark.createDataFrame([], changes.STATE)
    for k, batch in enumerate(batches):
        state = changes.merged(state, spark.createDataFrame(batch, tables.EVENTS))
        if k % 4 == 3:
            state = tables.stored(state, "state")
    assert {(r["drive"], r["file_ref"]): r["name"] for r in changes.live(state).collect()} == model


def test_junk_under_change(spark):
    start = records(spark, [(1, 0, "Users", True), (10, 1, "Alice", True), (11, 10, "report.txt", False), (12, 10, "photo.PNG", False), (13, 0, "node_modules", True), (14, 13, "lodash.js", False), (15, 0, "Temp", True)])
    entries, junk = hierarchy.prune(start)
    batch = [event(1, "created", 20, "zeta", 1, is_dir=True), event(2, "created", 21, "app.js", 20), event(3, "renamed", 10, "Bob", 1, 10, is_dir=True), event(4, "moved", 11, "report.txt", 20), event(5, "deleted", 12), event(6, "created", 42, "into", 0), event(7, "moved", 42, "into", 15)]
    state = changes.merged(changes.from_scan(entries), spark.createDataFrame(batch, tables.EVENTS))
    now, refs_now = changes.with_junk(state, junk)
    got = {r["name"]: (r["depth"], r["user_path"]) for r in now.collect()}
    assert set(got) == {"app.js", "Bob", "node_modules", "report.txt", "Users", "zeta", "Temp"} and got["app.js"] == (2, 1) and got["report.txt"] == (2, 1) and got["Bob"] == (1, 1)
    assert {r["file_ref"] for r in refs_now.collect()} == {14, 42}
    # deletion forgets a junk ref, moving out of junk brings it back, what a pruned directory holds is junk
    more = [event(8, "deleted", 14), event(9, "moved", 42, "into", 1), event(10, "created", 50, "in pruned", 60)]
    state = changes.merged(state, spark.createDataFrame(more, tables.EVENTS))
    now, refs_now = changes.with_junk(state, refs_now.union(spark.createDataFrame([("C", 60)], "drive string, file_ref long")))
    assert {r["file_ref"] for r in refs_now.collect()} == {50, 60} and 42 in {r["file_ref"] for r in now.collect()}


def test_random_batches_into_buckets(spark, tmp_path, monkeypatch):
    """Batches of a journal in state that is merged often, some of them twice, against a dictionary; junk against a walk."""
    monkeypatch.setattr(log_state, "LEVEL0_RUNS", 2)
    path, rng, model, seq = f"file://{tmp_path}/state", random.Random(11), {}, 0
    for _ in range(8):
        batch = []
        for _ in range(rng.randint(1, 12)):
            seq += 1
            drive, ref, op = rng.choice("CD"), rng.randint(1, 15), rng.choice(["created", "deleted", "moved", "renamed"])
            name, old, parent = rng.choice(["temp", "users", "a", "b", "c"]), rng.randint(1, 15) if op == "renamed" else None, rng.randint(0, ref - 1)
            batch.append(event(seq, op, ref, name, parent, old, drive, is_dir=True))
            if old is not None and old != ref:
                model.pop((drive, old), None)
            model.pop((drive, ref), None)
            if op != "deleted":
                model[drive, ref] = (parent, name)
        for _ in range(rng.randint(1, 2)):
            changes.apply_batch(spark, path, spark.createDataFrame(batch, tables.EVENTS))
    state, checkpoints = changes.load_state(spark, path)
    assert {(r["drive"], r["file_ref"]): (r["parent_ref"], r["name"]) for r in changes.live(state).collect()} == model
    assert max(r["next_seq"] for r in checkpoints.collect()) == seq
    entries, junk = changes.with_junk(state, spark.createDataFrame([], "drive string, file_ref long"))

    def in_junk(drive, ref):
        parent = model[drive, ref][0]
        return (drive, parent) in model and (model[drive, parent][1] == "temp" or in_junk(drive, parent))

    assert {(r["drive"], r["file_ref"]) for r in junk.collect()} == {k for k in model if in_junk(*k)}
    assert all(1 <= r["depth"] <= 15 and r["user_path"] in (0, 1) for r in entries.collect())


def test_snapshot_and_replay(spark, tmp_path):
    path, source, saved = f"file://{tmp_path}/snap", tmp_path / "in", f"file://{tmp_path}/saved"
    assert changes.load_state(spark, path) is None and tables.load_snapshot(spark, saved) is None and tables.drop_old_versions(spark, saved) == []
    roots, no_junk = spark.createDataFrame([("C", "C:\\")], "drive string, root string"), spark.createDataFrame([], "drive string, file_ref long")
    assert changes.compact(spark, path, saved, roots, no_junk) is None
    source.mkdir()
    for k, rows in enumerate(([event(3, "deleted", 1), event(4, "created", 2), event(7, "checkpoint", 0)], [event(1, "created", 1), event(2, "created", 9)])):
        spark.createDataFrame(rows, tables.EVENTS).coalesce(1).write.json(f"file://{tmp_path}/w{k}")
        part = next((tmp_path / f"w{k}").glob("part*.json"))
        part.rename(source / f"{k}.json")
        changes.replay(spark, f"file://{source}", path, f"file://{tmp_path}/offsets").awaitTermination()
    state, checkpoints = changes.load_state(spark, path)
    assert refs(state) == {("C", 2), ("C", 9)} and [tuple(r) for r in checkpoints.collect()] == [("C", 7)]
    assert changes.compact(spark, path, saved, roots, no_junk, every=3) is None
    assert changes.compact(spark, path, saved, roots, no_junk) == 1 and refs(changes.load_state(spark, path)[0]) == {("C", 2), ("C", 9)}
    found = tables.load_snapshot(spark, saved)
    assert {r["table_name"]: r["n"] for r in tables.describe_snapshot(found).collect()} == {"entries": 2, "junk_refs": 0, "roots": 1, "checkpoints": 1}
    assert all(r["ok"] for r in tables.validate_snapshot(found).collect())
    assert {r["check"] for r in tables.validate_snapshot({"entries": found["entries"].union(found["entries"]).withColumn("depth", F.lit(0)), "roots": roots.limit(0)}).where("not ok").collect()} == {"roots_exist", "depths_in_range", "refs_once", "drives_rooted"}
    # an empty rebuild keeps the old one, two more versions push out the first
    assert tables.save_snapshot({"entries": found["entries"].limit(0)}, saved, keep_if_empty="entries") is None and tables.latest_version(spark, saved) == 1
    for _ in range(2):
        tables.save_snapshot({"entries": found["entries"]}, saved)
    assert len(tables.drop_old_versions(spark, saved)) == 1 and tables.load_snapshot(spark, saved)["entries"].count() == 2
    assert versions.publish(spark, f"{saved}/_versions", 99, {"format": 0, "folder": "x", "tables": {"state": 1}})
    assert tables.load_snapshot(spark, saved) is None  # another format asks for a rebuild


def test_files_and_pool_refresh(spark, tmp_path):
    import datetime

    from lodestone.sources import files

    (tmp_path / "d.json").write_text('{"drive": "C", "root": "C:\\\\", "file_system": "NTFS"}\n{"drive": "D", "file_system": "FAT32"}\nbroken\n')
    (tmp_path / "a.csv").write_text("source,src_prio,ordinal,name,path\nreg,0,1,App,C:\\a.exe\nreg,x,2,Bad,C:\\b\nreg,0,3,,C:\\c\n")
    assert [r["drive"] for r in files.read_drives(spark, f"file://{tmp_path}/d.json").collect()] == ["C"]
    schema = "source string, src_prio int, ordinal int, name string, path string"
    (tmp_path / "src").mkdir()
    spark.createDataFrame([("reg", 0, 1, "App", "C:\\a.exe"), ("reg", 0, 3, "", "C:\\c")], schema).write.mode("append").json(f"file://{tmp_path}/src")
    found = files.read_app_sources(spark, f"file://{tmp_path}/src").collect()
    assert [(r["name"], r["path"], r["icon"]) for r in found] == [("App", "C:\\a.exe", None)]
    meta = {r["path"].rpartition("/")[2]: r["length"] for r in files.file_metadata(spark, f"file://{tmp_path}").collect()}
    assert meta["d.json"] == (tmp_path / "d.json").stat().st_size
    with pytest.raises(ValueError):
        files.read_listing(spark, "x", "orc")
    apps, pool = spark.createDataFrame([("A", "C:\\a"), ("B", "C:\\b")], "name string, path string"), f"file://{tmp_path}/pool"
    assert [files.refresh_pool(a, pool) for a in (apps.limit(0), apps, apps.withColumn("path", F.upper("path")), apps.limit(1), apps.limit(0))] == [None, 1, None, 2, None]
    now = datetime.datetime(2024, 1, 1, 0, 2, tzinfo=datetime.UTC)
    assert [changes.is_stale(p, now) for p in (None, {"timestamp": "2024-01-01T00:00:59.000Z"}, {"timestamp": "2024-01-01T00:01:01.000Z"})] == [True, True, False]


def test_replay_again(spark, tmp_path, monkeypatch):
    """A replay that fails twice and then goes on; one that always fails."""
    source, path = tmp_path / "in", f"file://{tmp_path}/state"
    source.mkdir()
    spark.createDataFrame([event(1, "created", 5)], tables.EVENTS).coalesce(1).write.json(f"file://{tmp_path}/w")
    next((tmp_path / "w").glob("part*.json")).rename(source / "0.json")
    apply, left = changes.apply_batch, [2]

    def failing(*args):
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("no")
        return apply(*args)

    monkeypatch.setattr(changes, "apply_batch", failing)
    assert changes.keep_replaying(spark, f"file://{source}", path, f"file://{tmp_path}/offsets", pause=0) == 2
    assert refs(changes.load_state(spark, path)[0]) == {("C", 5)}
    left[0] = 99
    with pytest.raises(Exception, match="no"):
        changes.keep_replaying(spark, f"file://{source}", f"file://{tmp_path}/other", f"file://{tmp_path}/offsets2", most_failures=2, pause=0)
    assert left[0] == 97


def test_difference_hash(spark):
    rng = random.Random(6)
    for w, h in ((64, 36), (5, 7), (130, 80), (1, 9)):
        light = [rng.randint(0, 255) for _ in range(w * h)]
        bits = [int(light[y * h // 36 * w + x * w // 64] > light[y * h // 36 * w + (x + 1) * w // 64]) for y in range(36) for x in range(63)] if w > 1 else None
        got = one(spark, X.difference_hash(F.col("a"), F.lit(w), F.lit(h)), [(light,)], "a array<int>")[0]
        assert got == (bits and [sum(b << k for k, b in enumerate(bits[i : i + 32])) for i in range(0, len(bits), 32)])


def test_index_follows_its_files(spark, tmp_path):
    """A search after a table was replaced sees the new rows."""
    import shutil

    from lodestone.plans import queries as plans

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    for name in ("region", "nation", "customer", "orders"):
        shutil.copy(f"{d}/{name}.parquet", tmp_path)
        (tmp_path / f"{name}.parquet").chmod(0o644)
    before = plans.ext_search_total(spark, f"file://{tmp_path}").first()[0]
    built = len(plans._SNAPSHOTS)
    assert before > 0 and plans.ext_search_total(spark, f"file://{tmp_path}").first()[0] == before and len(plans._SNAPSHOTS) == built
    spark.read.parquet(f"{d}/orders.parquet").limit(0).coalesce(1).write.parquet(f"file://{tmp_path}/new")
    next((tmp_path / "new").glob("part*.parquet")).replace(tmp_path / "orders.parquet")
    assert plans.ext_search_total(spark, f"file://{tmp_path}").first()[0] == 0


def test_exclusions_and_pool(spark, tmp_path):
    (tmp_path / "x.txt").write_text(" C:\\Foo\\ \n\n c:\\BAR\\\n")
    assert {r["prefix"] for r in tables.read_exclusions(spark, f"file://{tmp_path}/x.txt").collect()} == {"c:\\foo\\", "c:\\bar\\"}
    (tmp_path / "pool.json").write_text('[{"name": "A", "path": "C:\\\\a.exe"}, {"name": "B", "path": "relative"}, {"path": "C:\\\\x"}]')
    assert [tuple(r) for r in tables.read_pool(spark, f"file://{tmp_path}/pool.json").collect()] == [("A", "C:\\a.exe")]


def test_parsed_records(spark):
    raw = spark.createDataFrame([("C", 1, 0, "PROGRA~1", True, True, 0), ("C", 1, 0, "posix", True, True, 3), ("C", 1, 0, "Win", True, True, 1), ("C", 2, 0, "gone", False, False, 1), ("C", 3, 0, "DOS", False, True, 0)], "drive string, file_ref long, parent_ref long, name string, is_dir boolean, in_use boolean, name_space int")
    assert names_of(tables.parsed_records(raw)) == ["Win"]


def test_sections(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, path string, is_dir boolean, rank int")
    whole = search.sections(make([("w", "web", False, 0)]), make([("app", "a", False, 0)]), make([("f", "f", False, 2), ("d", "d", True, 3)]))
    assert [(r["section"], r["path"]) for r in whole.collect()] == [(0, "web"), (2, "a"), (3, "d"), (4, "f")]
    assert [r["path"] for r in search.next_page(make([("f", "f", False, 2), ("g", "g", False, 2)]), make([("f", "f", False, 2)])).collect()] == ["g"]


def test_registered_queries_against_sql(spark):
    import os

    import duckdb

    from lodestone.plans import queries as plans

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for f in os.listdir(d):
        db.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).map(lambda v: v.item() if hasattr(v, "item") else v).itertuples(index=False, name=None)))

    for name, sql in plans.ORACLE_SQL.items():
        assert rows(plans.QUERIES[name](spark, d).toPandas()) == rows(db.sql(sql).df()), name
