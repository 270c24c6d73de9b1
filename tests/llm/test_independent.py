"""Operators against programs that share no code with them."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from wayfind.llm import media, url_filter


def smooth(plane):
    """The usual doubling of chroma in both directions: three parts of the nearer sample, one of the farther, edges repeated."""
    p = np.pad(plane.astype(int), 1, mode="edge")
    tall = np.empty((2 * plane.shape[0], p.shape[1]), int)
    tall[0::2], tall[1::2] = 3 * p[1:-1] + p[:-2], 3 * p[1:-1] + p[2:]
    wide = np.empty((tall.shape[0], 2 * plane.shape[1]), int)
    wide[:, 0::2], wide[:, 1::2] = 3 * tall[:, 1:-1] + tall[:, :-2] + 8, 3 * tall[:, 1:-1] + tall[:, 2:] + 7
    return wide >> 4


def test_files_are_read_by_another_decoder(spark):
    """The virtual machine's own image reader gives the same samples, give or take its rounding."""
    random.seed(5)
    words = ["plain", "words", "ünïcode", "of", "a", "text", "{}", "~~~", "0123", "\n"]
    texts = ["", "a", "x" * 192, " ".join(random.choices(words, k=90)), " ".join(random.choices(words, k=700)), "zebra " * 900]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = media.media(docs)
    files = {r.doc_id: bytes(r.jpeg) for r in stored.collect()}
    own = {r.doc_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in media.tensors(stored).collect()}
    jvm = spark._jvm
    for i, raw in files.items():
        reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
        reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(raw)))
        raster = reader.readRaster(0, None)
        size = (raster.getHeight(), raster.getWidth())
        assert size == own[i].shape[:2] and raster.getNumBands() == 3
        y, cb, cr = (np.array(list(raster.getSamples(0, 0, size[1], size[0], b, None))).reshape(size) for b in range(3))
        image = media.decode([raw])[0]
        planes = []
        for coefficients, quant, (h, v) in zip(image.coefficients, image.quant, image.sampling, strict=True):
            across, down = size[1] // 16 * h, size[0] // 16 * v
            planes.append(media.samples(coefficients, quant).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across))
        assert np.abs(planes[0].astype(int) - y).max() <= 1
        assert np.abs(smooth(planes[1]) - cb).max() <= 2 and np.abs(smooth(planes[2]) - cr).max() <= 2
        # The tensor repeats chroma where the reader smooths it; from the same planes the usual colour equations give its pixels.
        b, r = (np.kron(p, np.ones((2, 2), int)).astype(float) - 128 for p in planes[1:])
        luma = planes[0].astype(float)
        want = np.clip(np.stack([luma + 1.402 * r, luma - 0.344136 * b - 0.714136 * r, luma + 1.772 * b], axis=2), 0, 255)
        assert np.abs(want - own[i]).max() <= 1


def test_report_features_by_a_plain_loop(spark):
    texts = ["", "short", "line of words " * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = media.media(docs)
    pixels = {r.doc_id: (r.height, r.width, r.rgb) for r in media.tensors(stored).collect()}
    files = {r.doc_id: bytes(r.jpeg) for r in stored.collect()}
    for row in media.report(docs).collect():
        height, width, data = pixels[row.doc_id]
        at = lambda y, x, c: data[(y * width + x) * 3 + c]  # noqa: B023, E731
        means = [sum(data[c::3]) // (height * width) for c in range(3)]
        cells = [sum(at(y, x, c) for y in range(i * (height // 8), (i + 1) * (height // 8)) for x in range(j * (width // 8), (j + 1) * (width // 8)) for c in range(3)) for i in range(8) for j in range(8)]
        bits = "".join("1" if 64 * c > sum(cells) else "0" for c in cells)
        assert row.feature == "-".join(map(str, means)) + "-" + f"{int(bits, 2):016x}"
        payload = texts[row.doc_id].encode().ljust(max(1, -(-len(texts[row.doc_id].encode()) // 192)) * 192)
        assert (row.payload_sha256, row.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(files[row.doc_id]).hexdigest())


def plain_strength(groups):
    """Strength of a prior from (k, n) of groups by the method of moments."""
    k, n, nn = sum(a for a, _ in groups), sum(b for _, b in groups), sum(b * b for _, b in groups)
    rate, df = k / n, len(groups) - 1
    between = sum((a - b * rate) ** 2 / b for a, b in groups)
    spread = between / (rate * (1 - rate)) - df if 0 < rate < 1 else None
    room = n - nn / n - df
    rho = spread / room if spread is not None and room else 0.0001
    return 1 / max(0.0001, min(0.5, rho)) - 1


def plain_reputations(outcomes):
    """host: (posterior rate, upper bound), and the overall rate; hosts are three labels, domains their last two, suffixes the last."""
    hosts, domains, suffixes = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for host, good in outcomes:
        for level, key in ((hosts, host), (domains, host.split(".", 1)[1]), (suffixes, host.rsplit(".", 1)[1])):
            level[key][0] += good
            level[key][1] += 1
    k, n = sum(v[0] for v in suffixes.values()), sum(v[1] for v in suffixes.values())
    overall = (k + 1) / (n + 2)
    s1, s2, s3 = (plain_strength(list(level.values())) for level in (suffixes, domains, hosts))
    p1 = {s: (k + s1 * overall) / (n + s1) for s, (k, n) in suffixes.items()}
    p2 = {d: (k + s2 * p1[d.rsplit(".", 1)[1]]) / (n + s2) for d, (k, n) in domains.items()}
    out = {}
    for h, (k, n) in hosts.items():
        p, weight = p2[h.split(".", 1)[1]], n + s3
        rate = (k + s3 * p) / weight
        out[h] = (rate, rate + 1.645 * math.sqrt(rate * (1 - rate) / (weight + 1)))
    return out, overall


def test_domains_and_suffixes_decide_about_sparse_hosts(spark):
    """Hosts with the same bad pages: those in a bad domain go, those in a good domain stay; and so by suffix, where one page is all that is known of a domain."""
    random.seed(3)
    outcomes = []
    for domain, rate, hosts in (("spam.biz", 0.05, 30), ("junk.biz", 0.1, 30), ("good.edu", 0.97, 30), ("fine.edu", 0.95, 30), ("mixed.net", 0.6, 60)):
        outcomes += [(f"h{h}.{domain}", int(random.random() < rate)) for h in range(hosts) for _ in range(25)]
    outcomes += [(f"new.{d}", 0) for d in ("spam.biz", "good.edu", "spam.biz", "good.edu", "fresh.biz", "fresh.edu")]
    pages = spark.createDataFrame([(i, f"http://{h}/page") for i, (h, _) in enumerate(outcomes)], "page_id long, url string")
    labels = spark.createDataFrame([(i, good) for i, (_, good) in enumerate(outcomes)], "doc_id long, quality int")
    got = {r.host: r for r in url_filter.reputations(pages, labels).collect()}
    want, overall = plain_reputations(outcomes)
    assert got.keys() == want.keys()
    for host, r in got.items():
        assert np.allclose([r.rate, r.upper, r.floor], [*want[host], overall])
    verdict = {r.host: r.verdict for r in url_filter.judge(pages, labels, rules=()).collect()}
    assert verdict == {h: "block" if upper < overall else "allow" for h, (_, upper) in want.items()}
    assert [verdict[f"new.{d}"] for d in ("spam.biz", "good.edu", "fresh.biz", "fresh.edu")] == ["block", "allow", "block", "allow"]
