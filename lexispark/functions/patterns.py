"""Pattern tables of the text classifiers and the column functions that read them.

The tables are parameters: every function takes another one for another corpus. Patterns keep to what Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of quoted lines; all that match hold, else general.
QUOTE_FAMILIES = [
    ("anger", "怒|切れ|有頂天|逆鱗|ふるかい|不快|謝(?:れ|っても遅|罪しろ)"),
    ("gratitude", "感謝|ありがとう|有難"),
    ("lament", "悲し|絶望|寿命|一巻の終わり|いくえ不明|手遅れ"),
    ("warning", "危険|気をつけ|死|骨になる|病院|裏世界|犯罪|逮捕"),
    ("victory", "勝|論破|カウンター|これで勝つる|最強|唯一ぬに"),
    ("humility", "謙虚|それほどでもない|一歩引く|心が広"),
    ("evidence", "証拠|証明|事実|ノンフィクション|見ろ|確定"),
    ("prediction", "予知|最初から|目に見えて|シュミレート|発覚"),
    ("comparison", "対等|格が違|対して|よりも|ナンバー|一般社会"),
    ("surprise", "びび|ギク|驚|ほう・・|おいィ|何いきなり"),
    ("power", "パワー|破壊力|ワンパン|パンチ|ノーリスク|加速|攻撃力"),
    ("instruction", "見習|べき|勉強|注意|改心|義務|しきたり"),
    ("denial", "関係ない|はげていない|狩られる側じゃない|大反対|ノーなんで"),
]

# Speech acts in order; the first that matches is the primary one. Matched on the text and on it without blanks.
SPEECH_ACTS = [
    ("gratitude", "感謝|ありがと|お礼|礼を言"),
    ("agreement", "賛成|同意|禿同|同じ意見|激しく同意|支持|確かにな"),
    ("attention_call", "おいィ|聞こえたか|見ろ[、,]|ほらみた|何いきなり|先に言っておく|覚えておけ"),
    ("apology_contract", "謝罪|謝る|あやま|約束|誓い|改心|許して|守られなければ"),
    ("grievance", "ずるい|卑怯|ヒキョウ|汚い|きたない|不公平|おかしい|恥知らず|非常に人をふるかい"),
    ("opponent_evaluation", "馬鹿|バカ|雑魚|ザコ|偽者|弱かった|弱々しい|烏合|浅はか|愚か|醜い|必死だな|反乱者|カス猿|口だけ"),
    ("social_typing", "チーム|四天王|タイプ|ミニオン|使う奴|使いがいた|性格が悪|反乱者|人気者|孤高の|○○美|不良界|一般人"),
    ("pseudo_logic", "公式が成り立|＝|=|だから|なので|なぜなら|ようするに|というのが|という事|結果だった|つまり|同然|証拠"),
    ("paradox_repetition", "稀にだがよく|普通は普通|唯一ぬに|パワーの力|破壊力.{0,12}破壊力|最強.{0,16}最強|前門の.{0,12}前門の"),
    ("lexical_reanalysis", "名誉既存|真骨董|多勢に風情|ぎゃくりん|だんぺん|ぜいいん|じょうずく|ヨミヨミ|ホイッスル|役不足|確信犯|太公望は釣竿|女王の守りというのが女"),
    ("withdrawal_closure", "一歩引く|シャッタアウト|じゃあな|闇系の仕事|このスレはしんだ|もう来なくて|幕を閉じ|これで終わり"),
    ("fear_submission", "怖い|震え|完敗|言い返す言葉|泣き|諦め|なす術なし|グーの音|黙った"),
    ("challenge_retort", "牙抜いて|ライバル視|張り合|勝負|相手になら|何いきなり|口だけ|カウンター"),
    ("threat_warning", "死ぬ|殺|殴|蹴|骨になる|病院|幕を閉じ|ボコ|危険|手遅れ|注意|謝るべき|やめろ馬鹿|仏の顔|バラバラ|ズタズタ"),
    ("denial_disclaimer", "ではない|じゃない|関係ない|偽者|捏造|無実|ノーなんで|違う|話は別|ノーダメージ|はげていない"),
    ("evidence", "証拠|証明|明らか|見ろ|ノンフィクション|事実|決定打|信頼性|見ればわか"),
    ("self_rank", "一級|最高|最強|ナンバー[１1]|Ｐ[ｽス]キル|憧れ|人気者|伝説|唯一ぬに|格が違|一般人|頼りにされる|誘いがあっては一人の時間"),
    ("power_action", "パワー|攻撃|パンチ|破壊|加速|雷属性|ホーリ|論破|封印|鉄の塊|防御|盾|武器|スウィフト|スウィスト|キラーマッシン|強すぎ|つよすぎ"),
    ("victory_result", "勝つる|勝率|圧勝|勝利|完全.{0,4}(?:解決|論破)|倒し|返した|終了|成功"),
    ("praise_humility", "それほどでもない|謙虚|誉め|褒め|感心|関心|見事|憧れ|すごいですね|心が広大|心配り|人気の秘訣|god job"),
    ("lament_crisis", "悲し|絶望|寿命|手遅れ|いくえ不明|ゲームオーバー|ｹﾞｰﾑｵｰﾊﾞｰ|一巻の終わり|顔面蒼白"),
    ("prediction_certainty", "予知夢|わかってた|目に見えて|シュミレート|確定的|最初から|間違いなく|決まって"),
    ("instruction", "するべき|すべき|するな|やめろ|注意|謝るべき|改心|見習|覚えておけ|知らないか"),
    ("reaction_inference", "びび|ギク|黙った|笑顔|表情|驚|グーの音|肩に暖か|泣き|恐怖|諦め|拳を上げ|誰それ|外人|歌[？?]"),
    ("metalinguistic", "英語でいう|って意味|という意味|読み方|文字|名前|名誉既存|役不足|確信犯"),
    ("repair_correction", "間違|勘違い|訂正|だった馬鹿|ちょっとミス|焦ってれば|言い間違"),
]

# What the text after an anchor says of the anchor's part in the line, in order.
ANCHOR_AFTER = [
    ("fused_performative", r"^(?:感謝|ありがとう|乙|謝罪|祝福)(?:\b|$)"),
    ("agreement_target", "^(?:に|の意見に)(?:超)?(?:賛成|同意|禿同)"),
    ("evidence_source", "^(?:に|で|が|を|の).{0,24}(?:証拠|証明|言うように|見て|内容|信頼性)"),
    ("evaluation_target", "^(?:は|が|お前).{0,32}(?:賢|馬鹿|バカ|偽者|嘘|死ぬ|能力|雑魚|必死)"),
    ("vocative", "^(?:よ[、,]?|お前)"),
]
AGREED = "(?:賛成|同意|禿同)$"

# Dimensions of style; all that match hold.
STYLE_DIMENSIONS = [
    ("viewpoint", "俺|おれ|お前|おまえ"),
    ("orthography", "[ｦ-ﾟ]|ぜいいん|すぐる|どちか|あもりにも"),
    ("connective", "やはり|しかも|さらに|だが|という話なんだが"),
    ("certainty", "事実|真実|明らか|決ま|高確率|確実"),
    ("amplification", "かなり|圧倒|最強|一級|超|致命的|絶望的|あもりにも|すぐる|本気を出"),
    ("signature", "有頂天|時既に|ｶｶッ|ばつ牛ﾝ|忍者きたない|アワレ|遅れをとる|騒ぐと危険"),
    ("reaction", "リアルでビビ|顔真っ赤|青ざめ|眼差し|らしい|震え|指先|手足|体温|吐く息|身体の動き"),
    ("rank", "一般人|一級|ランク|格の違い"),
]

# Families of how a variation ends and how a narrative opens, in order.
VARIATIONS = [
    ("question", "でしょう[？?]?$"), ("complaint", "んだが[？?]?$"), ("certainty", "確定的に明らか$"), ("assertion", r"だろ(?:・・|\.\.)?$"),
    ("danger", "時既に時間切れ|致命的な致命傷|寿命がﾏｯﾊ"), ("reaction", "驚き|眼差し|言葉を失|格の違い"),
]
NARRATIVES = [
    ("acquaintance", "^これは俺の知り合いの(?:ﾅｲﾄ|ナイト)"), ("rumor", "^LSで"), ("result-first", "^最初に結果だけ言うと"), ("evidence-first", "^証拠から先に"),
    ("aftershock-first", "^後になって"), ("quote-open", "^(?:おいィ？|まぁこうなる|英語でいうと|何いきなり|これは闇系)"),
    ("lament-first", r"^(?:[^\n]*(?:寿命がストレス|深い悲しみ|想像を絶する|ｓＹレならん|手遅れ|いくえ不明|ｹﾞｰﾑｵｰﾊﾞｰ|牙抜いて))"),
    ("witness", r"^俺はその場にいたんだが|^[^\n]+(?:騒いでいた|顔を真っ赤|助けを求め|泣き言|混乱は止まらない)"),
]

# What adds to the score of a sentence that tells an achievement. A plan is no achievement, unless it was kept.
PLAN_KEPT = "予定(?:より|していた|しており|通り|どおり)"
ACHIEVEMENT = [
    (6, "完了|成功|完成|提出|解決|復旧|回復|改善|短縮|勝利|達成|修理|修正|直した|解消|到着|決まった|まとまった|消え|収ま|落ち着|全滅|撃退|退け|消滅|救出|切り抜け|満点|100点|一番(?:に|を)?(?:なった|取った)|一位|首位"),
    (5, "間に合った|提出できた|予定より早|使える状態に戻った|取り返し|おかわり|感謝|評価|褒め|早かったと言われ"),
    (4, "わかった|分かった|理解でき|判明|納得|助かった"),
    (6, "[0-9]+(?:分|時間|件|人|秒).{0,18}(?:から|より).{0,18}[0-9]+(?:分|時間|件|人|秒)"),
    (4, "作った|作成した|実装した|導入した|用意した|切り替えた|完成させた"),
    (6, "作りました|作成しました|実装しました|導入しました|用意しました|切り替えました|完成させました"),
    (2, "導入|実装|作成|作った|行った|実行|開始"),
    (3, "^(?:その結果|結果として)"),
    (-5, "原因は|設定ミス|できな|間に合わな|停止|遅れ|倒され|奪われ|焦げ|誤っ|失敗|残って"),
]
PLANNED = (-8, "予定|明日|来週|来月|来年|後日|今後|これから")
# A sentence tells an action only if ACTION matches; these add to its score.
ACTION = "導入|実装|作成|分類|修正|復旧作業|対策|調整|組み立て|作った|作り|用意|切り替え|構築|開発|自動化|追加|組ん|画面を作"
SELF = "(?:俺|私|僕|自分)(?:は|が)"
ACTIONS = [
    (8, SELF + ".{0,80}(?:導入|実装|作成|修正|対策|調整|作った|作り|用意|切り替え|構築|開発|自動化|追加|組ん|画面を作)"),
    (3, "作った|作成した|実装した|導入した|用意した|切り替えた|修正した|組んだ"),
    (-8, "早く.{0,8}(?:作って|用意して).{0,8}(?:と|って)|(?:作って|用意して)と(?:頼|叫|言)"),
]
PROBLEM = "できな|できそうにな|分からな|まとまらな|間に合わ|間に合いそうにな|間に合いそうもない|終わっていな|未完了|追われ|混雑|長い列|待ち時間.{0,12}(?:長|増)|問題|失敗|衝突|見失|迷っ|視界|濃霧|煙|火が上|遅れ|遅延|処理待ち|原因.{0,12}(?:分から|わから)|停止|切れ|切断|消え|残って|倒され|奪われ|焦げ|誤っ|警告|エラー|異常|不具合|障害|不足|壊れ|剥がれ|寒気|恐怖|恐い|怖い|違和感|おかしい|死体|襲|吊ろう|吊り上げ|かじか|紛失"

# First-match lookups of persona, topic and evaluation.
PERSONAS = [
    ("ﾌﾟﾛｸﾞﾗﾏｰ", "開発|ツール|システム|プログラ|コード|修正版|サーバー|復旧|監視|自動|タブレット|受付画面|データ"),
    ("ﾌﾟﾚｲﾔｰ", "ゲーム|武器|攻撃|プレイヤー|勝|負け"), ("料理人", "料理|カレー|炒め|煮込|焼い|鍋"), ("会社員", "会社|会議|仕事|報告|資料|担当"),
]
TOPICS = [
    ("寒さ", "寒|冷た|かじか"), ("暑さ", "暑|熱中"), ("雨", "雨|豪雨"),
    ("風", "風が.{0,4}強|強風|風で.{0,10}(?:歩けな|進めな|倒れ|飛ばされ)|風に(?:煽ら|飛ばされ)|(?:手|体|身体|顔|耳|指|足).{0,8}風で.{0,8}(?:寒|冷)"),
    ("疲労", "疲|だる"), ("眠気", "眠い|眠く|眠気|眠かっ|寝不足"),
]
EVALUATIONS = [
    ("negative:貧弱さ", "つまらな|面白くな"), ("negative:貧弱さ", "不便|使いにく|まずい|弱い|悪い|ひどい"), ("positive:面白さ", "面白|おもしろ"), ("positive:楽しさ", "楽しい|楽し"),
    ("positive:便利さ", "便利|使いやす"), ("positive:うまさ", "美味|おいし|うまい"), ("positive:良さ", "強い|優れ|素晴らし|すごい|良い|いい"),
]

# The part a line plays, in order; lines with quotes are dialogue, the first line else sets the scene.
SURFACE_ROLES = [
    ("future", "翌朝|翌日|翌週|明日|来週|今後|これから|次回|次は"),
    ("evaluation", "感心|評価|思った|確信|理解した|見習|素晴ら|すばら|スゴイ|すごい"),
    ("aftermath", "後日|帰り道|帰路|後から|聞いた話|そのあと|その後"),
    ("reveal", "真相|正体|判明|気[が付づ]|分かった|理解した|ではなく|首吊り死体|種明かし"),
    ("result", "全滅|消滅|片付|完成|完了|成功|到着|復旧|間に合|勝利|決まった|落ち着いた|取り返|特定|突き止め|見つけ出|短くな|縮ま|減った|増えた"),
    ("problem", "恐怖|異変|違和感|危険|故障|障害|遅れ|間に合わ|混乱|衝突|迷|霧|煙|炎|火が|寒気|震え|叫|泣|見失|分からなく|できなく|停止|倒され|奪われ"),
    ("action", "作[っる]|作成|修正|実装|導入|用意|整理|確認|点検|投入|助け|止め|振り|構え|参戦|移動|歩|向か|決め|選ん|見上げ|取り出|乗り込|飛び乗"),
]

# Who a sentence is aimed at: (roles, pattern); group 1 is the target.
TARGETS = [
    ("opponent", "^(.{1,24}?)(?:が|は).{0,80}(?:勝負|挑ん|挑戦|張り合|ライバル|競争|文句|批判|否定|反対|言い争|(?:自分|俺|私|僕)の方が.{0,18}(?:速|早|強|上手|優|できる|正しい).{0,18}(?:言|主張|豪語))"),
    ("opponent", "^(.{1,20}?)(?:から|に).{0,60}(?:文句|批判|否定|反対|挑発)"),
    ("speaker", "^([^「『]{1,20})[「『]"),
    ("source,supporter", "^(.{1,24}?)(?:の説明|の解説|の助言|の案内|の手ほどき|のおかげ|の話|の情報|の指摘).{0,60}(?:わか|分か|理解|判明|気づ|助か|解決|納得)"),
    ("source,supporter", "^(.{1,20}?)(?:から|に)(?:教え|聞い|説明され|助けられ)"),
    ("source,supporter", "^(.{1,24}?)(?:の意見|の提案|の考え|の案).{0,50}(?:賛成|同意|納得|正しい|支持)"),
    ("source", "^(.{1,24}?)(?:のデータ|のログ|の記録|の証言).{0,50}(?:原因|障害|停止|事実|結果).{0,24}(?:証明|示|確認|判明)"),
    ("source", "^(.{1,24}?(?:ログ|記録|データ))(?:には|に|が|は).{0,80}(?:記録|示|確認|原因)"),
]
# Steps that clean a target; what remains of these is no target.
TARGET_CLEANUP = [("^(?:今日|昨日|今朝|さっき|突然|いきなり)[、,]?", ""), ("^.*[、,]", ""), ("^(?:俺|私|僕|自分)の", ""), (r"[\s　]+", ""), ("[「『].*$", ""), ("(?:が|は|から|に)$", "")]
NO_TARGET = "^(?:[ぁ-んァ-ヶー]|俺|私|僕|自分|こちら|一部|全部|全体|すべて|結果|原因|情報|データ|記録|ログ|機能)?$"

# Steps that clean a candidate text.
CLEANUP = [(r"[ \t]+", " "), (r"\s+([。、！？!?])", r"\1"), ("。{2,}", "。"), ("必要不可欠不可欠", "必要不可欠"), ("かなりかなり", "かなり")]

# Protected literals by kind; a kind does not look inside the literals of the kinds before it.
PROTECTED = [
    ("url", r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("anchor", r"(?:>>|＞＞)\s*[0-9０-９]+"),
    ("identifier", "[A-Za-zＡ-Ｚａ-ｚ][A-Za-zＡ-Ｚａ-ｚ0-9０-９_-]*"),
    ("quantity", "[+＋－−-]?[0-9０-９]+(?:[,，][0-9０-９]{3})*(?:[.．][0-9０-９]+)?(?:時間|か月|ヶ月|[%％円年月日時分秒個枚人回点件歳才台度℃]|kg|km|cm|mm)?"),
]

# Words that stand for the speaker and the one spoken to, when variants are compared.
SELVES, YOUS = "(?:わたし|ぼく|おれ|私|僕|俺)(は|が|を|に|の|と|も|で)", "(?:あなた|おまえ|お前|きみ|君)(は|が|を|に|の|と|も|で)"


def labels(c: Column, table: list[tuple[str, str]], default: str | None = None) -> Column:
    """Names of all patterns that occur, in the order of the table; the default, if any, where none does."""
    hits = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in table]))
    return hits if default is None else F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def first(c: Column, table: list[tuple[str, str]], default: str | None = None) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in table], F.lit(default))


def score(c: Column, table: list[tuple[int, str]]) -> Column:
    """Sum of the points of the patterns that occur."""
    out = F.lit(0)
    for n, p in table:
        out = out + F.when(c.rlike(p), n).otherwise(0)
    return out


def achievement(c: Column) -> Column:
    return score(c, ACHIEVEMENT) + score(F.regexp_replace(c, PLAN_KEPT, ""), [PLANNED])


def action(c: Column) -> Column:
    """Null (none) for a sentence without an action."""
    lost = F.when(c.rlike(PROBLEM) & ~c.rlike(SELF), -6).otherwise(0)
    return F.when(c.rlike(ACTION), F.lit(1) + score(c, ACTIONS) + lost)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "「[^」]*」|『[^』]*』", "")


def surface_role(c: Column, index: Column) -> Column:
    """The part of a line of a text, by its 0-based number among the lines."""
    return F.when(c.rlike("[「『]"), "dialogue").otherwise(F.coalesce(first(unquoted(c), SURFACE_ROLES), F.when(index == 0, "setting"), F.lit("background")))


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Regular replacements one after another; group references as \\1."""
    for p, to in steps:
        c = F.regexp_replace(c, p, to.replace("\\1", "$1"))
    return c


def clean_target(c: Column) -> Column:
    """A target without time words, earlier phrases, possessives, quotes and particles; null if nothing of use is left."""
    t = F.trim(replaced(c, TARGET_CLEANUP))
    return F.when((F.length(t) <= 20) & ~t.rlike(NO_TARGET), t)


def clean_candidate(c: Column) -> Column:
    return F.trim(replaced(c, CLEANUP))


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))


def protected(c: Column) -> Column:
    """array<struct<kind, raw>> of the protected literals, kind by kind."""
    parts, rest = [], c
    for kind, p in PROTECTED:
        found = F.coalesce(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), F.array().cast("array<string>"))
        parts.append(_of_kind(found, kind))
        rest = F.regexp_replace(rest, p, " ")
    return F.flatten(F.array(*parts))


#: Frames of the placeholders of masked stretches; texts that hold them are not masked.
OPEN, CLOSE = "", ""


def mask(c: Column, pattern: str) -> tuple[Column, Column]:
    """The text with every match of pattern replaced by a numbered placeholder, and the array of what was replaced."""
    parts, kept = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    held = F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE))).otherwise(""), x))
    return F.array_join(held, ""), kept


def unmask(c: Column, kept: Column) -> Column:
    """A masked text with its placeholders, wherever they now stand, replaced by what they stand for."""
    parts = F.split(c, OPEN, -1)
    one = lambda x, i: F.when(i == 0, x).otherwise(F.concat(
        F.element_at(kept, F.split_part(x, F.lit(CLOSE), F.lit(1)).cast("int") + 1), F.regexp_replace(x, f"^[0-9]+{CLOSE}", "")))
    return F.array_join(F.transform(parts, one), "")


def anchor_class(before: Column, after: Column, line: Column, anchors: Column) -> Column:
    """The part of an anchor in its line, by the text on both sides."""
    return (
        F.when(anchors > 1, "coordination").when((before == "") & (after == ""), "standalone_reply")
        .otherwise(F.coalesce(
            F.when(after.rlike(ANCHOR_AFTER[0][1]), ANCHOR_AFTER[0][0]), F.when(after.rlike(ANCHOR_AFTER[1][1]) | line.rlike(AGREED), ANCHOR_AFTER[1][0]), first(after, ANCHOR_AFTER[2:]),
            F.when((before != "") & (after != ""), "embedded_argument"), F.when(before == "", "prefixed_clause"), F.lit("sentence_tail_reference"),
        ))
    )


def variant_text(c: Column) -> Column:
    """What variants are compared by: speaker and listener words as one each, marks and blanks dropped."""
    t = F.regexp_replace(F.regexp_replace(c, SELVES, "<SELF>$1"), YOUS, "<YOU>$1")
    return F.regexp_replace(t, r"[\p{P}\p{Z}\s]", "")
