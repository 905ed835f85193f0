"""Script folding before rules are applied."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, one to one.
ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

# Common traditional characters, each before its simplified form, one to one (public Unihan variants).
_PAIRS = """
體体 國国 學学 會会 長长 東东 車车 馬马 魚鱼 鳥鸟 龍龙 門门 開开 關关 間间 問问 聞闻 電电 雲云 風风 飛飞 書书 畫画 話话 語语 說说 讀读 記记 計计 訂订
討讨 設设 許许 評评 詞词 試试 詩诗 詳详 誠诚 誤误 請请 論论 調调 談谈 講讲 證证 識识 議议 護护 變变 讓让 財财 貨货 貴贵 買买 費费 資资 賣卖 質质 購购
軍军 軟软 較较 輕轻 輪轮 轉转 農农 進进 運运 過过 達达 違违 遠远 適适 還还 邊边 鄉乡 釋释 針针 銀银 錢钱 錯错 鍵键 鏡镜 鐵铁 陣阵 陰阴 陳陈 陽阳 階阶
際际 隨随 險险 難难 靜静 頁页 項项 順顺 須须 預预 領领 頭头 題题 額额 顏颜 願愿 類类 顯显 館馆 驗验 點点 齊齐 歲岁 歷历 歸归 氣气 決决 沒没 測测 準准
溫温 滿满 漢汉 無无 熱热 爭争 爾尔 獨独 現现 環环 產产 當当 療疗 發发 監监 盤盘 確确 禮礼 種种 積积 穩稳 窮穷 競竞 筆笔 節节 範范 簡简 糧粮 約约 級级
"""
CHINESE = ("".join(p[0] for p in _PAIRS.split()), "".join(p[1] for p in _PAIRS.split()))


def fold_letters(text: Column, table: tuple[str, str] = ACCENTS) -> Column:
    """Replace each letter of the first string by the one at its place in the second."""
    if len(table[0]) != len(table[1]):
        raise ValueError("both strings of a folding table must have the same length")
    return F.translate(text, *table)


def fold_words(text: Column, table: Mapping[str, str]) -> Column:
    """Replace longer variants, the longest first, so that a part never goes before the whole."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0])), text)
