import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from helpers import EDGES, WORD, edges, frame
from costmart.llm import fertility

SF = "/root/testdata/sf0.001"


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def test_base_and_measures_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    piece = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in fertility.measure(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert tuple(g[1:7]) == brute_base(r["text"])
        words = WORD.findall(r["text"] or "")
        tokens = sum(len(byte.encode(f" {w}", add_special_tokens=False).ids) for w in words)
        ids = [i for w in words for i in piece.encode(w)]
        counts = np.array(list(Counter(ids).values()))
        assert g["n_tokens"] == tokens
        assert math.isclose(g["fallback_share"],
                            sum(map(piece.is_byte, ids)) / max(1, len(ids)), abs_tol=1e-12)
        entropy = -(counts / len(ids) * np.log2(counts / len(ids))).sum() if ids else 0
        assert math.isclose(g["token_entropy"], entropy, abs_tol=1e-9)


def test_edges(spark):
    got = {r["doc_id"]: r for r in fertility.measure(edges(spark)).collect()}
    for row in EDGES:
        assert tuple(got[row[0]][1:7]) == brute_base(row[1])
    assert not got[1]["kept"] and got[1]["base_failed"] and got[1]["n_tokens"] == 0
    assert fertility.measure(frame(spark, [])).collect() == []


def test_bands_reject_and_keep(spark):
    prose = "The quick brown fox jumps over the lazy dog while seven wise owls watch it quietly."
    gibberish = " ".join(chr(0x220 + i) + chr(0x236 + i % 9) * 3 for i in range(20))
    same = " ".join(f"{'ha' * 12}" for _ in range(12))
    docs = frame(spark, [(1, prose, "en", "s", 1), (2, gibberish, "en", "s", 1),
                         (3, same, "en", "s", 1)])
    assert [r["doc_id"] for r in fertility.keep_good(docs).collect()] == [1]
    narrow = {k: fertility.Band(4.9, 5.0, 0.0) for k in fertility.BANDS}
    assert fertility.keep_good(docs, bands=narrow).collect() == []
    assert fertility.keep_good(edges(spark)).columns == edges(spark).columns


def test_scripts():
    assert fertility.dominant_script("Пример текста abc") == "cyrillic"
    assert fertility.dominant_script("日本語のテキスト") == "cjk"
    assert fertility.dominant_script("über alles") == "latin"
    assert fertility.dominant_script("123 !?") == "other"


# Script -> clean sentences, and ranges of letters for random words.
SAMPLES = {
    "latin": (["The committee met on Tuesday to discuss the new budget, and after a long debate the "
               "members agreed that the school should receive more money next year."],
              ["bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz"]),
    "latin_marked": (["Komisja zebrała się we wtorek, aby omówić nowy budżet, i po długiej dyskusji "
                      "członkowie zgodzili się, że szkoła powinna otrzymać więcej pieniędzy.",
                      "Ủy ban đã họp vào thứ ba để thảo luận về ngân sách mới, và sau một cuộc "
                      "tranh luận dài các thành viên đồng ý"], [(0xC0, 0x250), (0x1E00, 0x1F00)]),
    "greek": (["Το σχολείο βρίσκεται κοντά στη θάλασσα και τα παιδιά πηγαίνουν εκεί κάθε πρωί με "
               "τα πόδια. Το καλοκαίρι ο καιρός είναι ζεστός."], [(0x3B1, 0x3CA), (0x370, 0x400)]),
    "cyrillic": (["Комитет собрался во вторник, чтобы обсудить новый бюджет, и после долгих споров "
                  "участники согласились.", "Мектеп теңізге жақын орналасқан және балалар ол жерге "
                  "күн сайын таңертең жаяу барады."], [(0x430, 0x450), (0x400, 0x530)]),
    "hebrew": (["הוועדה התכנסה ביום שלישי כדי לדון בתקציב החדש, ולאחר דיון ארוך הסכימו החברים שבית "
                "הספר צריך לקבל יותר כסף."], [(0x5D0, 0x5EB)]),
    "arabic": (["اجتمعت اللجنة يوم الثلاثاء لمناقشة الميزانية الجديدة، وبعد نقاش طويل اتفق الأعضاء",
                "اسکول سمندر کے قریب ہے اور بچے ہر صبح پیدل وہاں جاتے ہیں۔ گرمیوں میں موسم گرم "
                "ہوتا ہے"], [(0x627, 0x64B), (0x600, 0x700)]),
    "indic": (["समिति ने मंगलवार को नए बजट पर चर्चा करने के लिए बैठक की, और लंबी बहस के बाद सदस्य सहमत हुए",
               "குழு செவ்வாய்க்கிழமை புதிய வரவு செலவுத் திட்டத்தைப் பற்றி விவாதிக்க கூடியது, நீண்ட "
               "விவாதத்திற்குப் பிறகு பள்ளிக்கு"], [(0x905, 0x93A), (0x985, 0x9BA), (0x900, 0xE00)]),
    "cjk": (["學校 在 海邊 附近 ， 孩子們 每天 早上 走路 去 那裡 。 夏天 天氣 很 熱",
             "学校は 海の 近くに あり、 子どもたちは 毎朝 歩いて そこへ 行きます。 夏は 天気が 暑く、 人々は",
             "학교는 바다 근처에 있고 아이들은 매일 아침 걸어서 그곳에 간다. 여름에는 날씨가 덥고"],
            [(0x4E00, 0x9FA6), (0x3041, 0x3097), (0xAC00, 0xD7A4)]),
    "armenian": (["Հանձնաժողովը հավաքվեց երեքշաբթի օրը՝ քննարկելու նոր բյուջեն, և երկար քննարկումից "
                  "հետո անդամները համաձայնեցին"], [(0x561, 0x587)]),
    "georgian": (["სკოლა ზღვასთან ახლოს მდებარეობს და ბავშვები იქ ყოველ დილით ფეხით მიდიან. "
                  "ზაფხულში ამინდი თბილია"], [(0x10D0, 0x10F1)]),
    "thai": (["โรงเรียน อยู่ ใกล้ ทะเล และ เด็กๆ เดิน ไป ที่นั่น ทุก เช้า ใน ฤดูร้อน อากาศ ร้อน"],
             [(0xE01, 0xE2F)]),
    "symbols": ([], [(0x2190, 0x2400), (0x2700, 0x27C0)]),
}


def test_each_band_parts_clean_text_from_random_letters(spark):
    rng, rows, want = random.Random(7), [], {}
    for script, (clean, alphabets) in SAMPLES.items():
        assert script in fertility.BANDS
        for text in clean:
            want[len(rows)] = (script, True)
            rows.append((len(rows), text, "x", "s", 1))
        for a in alphabets:
            letters = a if isinstance(a, str) else [
                chr(c) for c in range(*a) if script == "symbols" or chr(c).isalpha()]
            text = " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(300))
            want[len(rows)] = (script, False)
            rows.append((len(rows), text, "x", "s", 1))
    got = {r["doc_id"]: r for r in fertility.measure(frame(spark, rows)).collect()}
    wrong = [(script, kept, got[i].asDict()) for i, (script, kept) in want.items()
             if got[i]["kept"] != kept or got[i]["script"] != script.partition("_")[0]]
    assert not wrong
