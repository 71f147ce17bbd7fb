"""Addresses with the parts that are right for them, for golden queries."""

from __future__ import annotations

#: Prefecture, city, ward, town and number of offices whose address is these parts in a row.
OFFICES = [
    ("岩手県", "盛岡市", None, "内丸", "1-1"),
    ("青森県", "青森市", None, "新町", "1-1"),
    ("宮城県", "仙台市", "青葉区", "本町", "3-8-1"),
    ("秋田県", "秋田市", None, "山王", "4-1-1"),
    ("山形県", "山形市", None, "松波", "2-8-1"),
    ("福島県", "福島市", None, "杉妻町", "2-16"),
    ("茨城県", "水戸市", None, "笠原町", "978-6"),
    ("栃木県", "宇都宮市", None, "塙田", "1-1-20"),
    ("群馬県", "前橋市", None, "大手町", "1-1-1"),
    ("埼玉県", "さいたま市", "浦和区", "高砂", "3-15-1"),
    ("千葉県", "千葉市", "中央区", "市場町", "1-1"),
    ("神奈川県", "横浜市", "中区", "日本大通", "1"),
    ("新潟県", "新潟市", "中央区", "新光町", "4-1"),
    ("富山県", "富山市", None, "新総曲輪", "1-7"),
    ("石川県", "金沢市", None, "鞍月", "1-1"),
    ("福井県", "福井市", None, "大手", "3-17-1"),
    ("山梨県", "甲府市", None, "丸の内", "1-6-1"),
    ("岐阜県", "岐阜市", None, "薮田南", "2-1-1"),
    ("静岡県", "静岡市", "葵区", "追手町", "9-6"),
    ("愛知県", "名古屋市", "中区", "三の丸", "3-1-2"),
    ("三重県", "津市", None, "広明町", "13"),
    ("滋賀県", "大津市", None, "京町", "4-1-1"),
    ("兵庫県", "神戸市", "中央区", "下山手通", "5-10-1"),
    ("奈良県", "奈良市", None, "登大路町", "30"),
    ("和歌山県", "和歌山市", None, "小松原通", "1-1"),
    ("鳥取県", "鳥取市", None, "東町", "1-220"),
    ("島根県", "松江市", None, "殿町", "1"),
    ("岡山県", "岡山市", "北区", "内山下", "2-4-6"),
    ("広島県", "広島市", "中区", "基町", "10-52"),
    ("山口県", "山口市", None, "滝町", "1-1"),
    ("徳島県", "徳島市", None, "万代町", "1-1"),
    ("香川県", "高松市", None, "番町", "4-1-10"),
    ("愛媛県", "松山市", None, "一番町", "4-4-2"),
    ("高知県", "高知市", None, "丸ノ内", "1-2-20"),
    ("福岡県", "福岡市", "博多区", "東公園", "7-7"),
    ("佐賀県", "佐賀市", None, "城内", "1-1-59"),
    ("長崎県", "長崎市", None, "尾上町", "3-1"),
    ("熊本県", "熊本市", "中央区", "水前寺", "6-18-1"),
    ("大分県", "大分市", None, "大手町", "3-1-1"),
    ("宮崎県", "宮崎市", None, "橘通東", "2-10-1"),
    ("鹿児島県", "鹿児島市", None, "鴨池新町", "10-1"),
    ("沖縄県", "那覇市", None, "泉崎", "1-2-2"),
]

#: Prefecture, county, town or village, its part, number, whether the number is a lot.
COUNTIES = [
    ("神奈川県", "中郡", "大磯町", "大磯", "1392", False),
    ("東京都", "西多摩郡", "日の出町", "平井", "2780", False),
    ("北海道", "石狩郡", "当別町", "白樺町", "200", False),
    ("埼玉県", "入間郡", "三芳町", "藤久保", "1100", False),
    ("長野県", "下高井郡", "野沢温泉村", "大字豊郷", "9817", True),
    ("沖縄県", "国頭郡", "国頭村", "字辺土名", "121", True),
    ("北海道", "二海郡", "八雲町", "本町", "110", False),
]

#: Address, number of candidates, parts that are there.
HARD = [
    ("三重県四日市市三番町1-2", 0, "prefecture=三重県;city=四日市市;lg_code=242021;town=三番町;ban=1;go=2;address_regime=unspecified"),
    ("東京都千代田区一番町1-1", 0, "prefecture=東京都;city=千代田区;lg_code=131016;town=一番町;ban=1;go=1;address_regime=unspecified"),
    ("東京都港区一番街1-1", 0, "prefecture=東京都;city=港区;lg_code=131032;town=一番街;ban=1;go=1;address_regime=unspecified"),
    ("東京都港区六本木6-10-1第1森タワー50F", 0, "prefecture=東京都;city=港区;lg_code=131032;town=六本木;chome=6;ban=10;go=1;building=第1森タワー;floor=50F;address_regime=gaiku_hoshiki"),
    ("東京都港区芝浦3-1-1 田町タワー 301", 0, "prefecture=東京都;city=港区;lg_code=131032;town=芝浦;chome=3;ban=1;go=1;building=田町タワー;unit=301;address_regime=gaiku_hoshiki"),
    ("京都府中京区御池通東洞院東入笹屋町436", 0, "prefecture=京都府;city=京都市;ward=中京区;lg_code=261041;town=笹屋町;banchi=436;address_regime=chiban"),
    ("京都府京都市上京区新町通下立売上る薮ノ内町", 0, "prefecture=京都府;city=京都市;ward=上京区;lg_code=261025;town=薮ノ内町;address_regime=unspecified"),
    ("札幌市中央区北1条西2丁目1番地", 0, "prefecture=北海道;city=札幌市;ward=中央区;lg_code=011011;chome=2;banchi=1;address_regime=chiban"),
    ("青森県八戸市大字鮫町字日出町1-1", 0, "prefecture=青森県;city=八戸市;lg_code=022039;town=大字鮫町字日出町;oaza=鮫町;koaza=日出町;banchi=1;edaban=1;address_regime=chiban"),
    ("東京都港区六本木三丁目10番地の1", 0, "prefecture=東京都;city=港区;lg_code=131032;town=六本木;chome=3;banchi=10;edaban=1;address_regime=chiban"),
    ("東京都港区芝公園4丁目2番8号東京タワー", 0, "prefecture=東京都;city=港区;lg_code=131032;town=芝公園;chome=4;ban=2;go=8;building=東京タワー;address_regime=gaiku_hoshiki"),
    ("大阪府大阪市北区梅田3丁目1番1号JR大阪駅地下1階", 0, "prefecture=大阪府;city=大阪市;ward=北区;lg_code=271276;town=梅田;chome=3;ban=1;go=1;building=JR大阪駅;floor=地下1階;address_regime=gaiku_hoshiki"),
    ("東京都千代田区大手町1-1-1大手町ビルB2F", 0, "prefecture=東京都;city=千代田区;lg_code=131016;town=大手町;chome=1;ban=1;go=1;building=大手町ビル;floor=B2F;address_regime=gaiku_hoshiki"),
    ("アメリカ合衆国ニューヨーク市", 0, "address_regime=unspecified"),
    ("東京都中央区八重洲1", 0, "prefecture=東京都;city=中央区;lg_code=131024;town=八重洲;ban=1;address_regime=unspecified"),
    ("東京都千代田区三番町", 0, "prefecture=東京都;city=千代田区;lg_code=131016;town=三番町;address_regime=unspecified"),
    ("東京都千代田区三番町1", 0, "prefecture=東京都;city=千代田区;lg_code=131016;town=三番町;ban=1;address_regime=unspecified"),
    ("福島県会津若松市一箕町大字亀賀字郷之原1", 0, "prefecture=福島県;city=会津若松市;lg_code=072028;town=一箕町大字亀賀字郷之原;oaza=亀賀;koaza=郷之原;banchi=1;address_regime=chiban"),
    ("神奈川県緑区1-1", 2, "prefecture=神奈川県;ward=緑区;ban=1;go=1;address_regime=unspecified"),
    ("大阪府西区1-1", 2, "prefecture=大阪府;ward=西区;ban=1;go=1;address_regime=unspecified"),
    ("神奈川県横浜市南区1-1", 0, "prefecture=神奈川県;city=横浜市;ward=南区;lg_code=141054;ban=1;go=1;address_regime=unspecified"),
    ("神奈川県相模原市南区1-1", 0, "prefecture=神奈川県;city=相模原市;ward=南区;lg_code=141534;ban=1;go=1;address_regime=unspecified"),
    ("大阪府大阪市北区梅田1-1", 0, "prefecture=大阪府;city=大阪市;ward=北区;lg_code=271276;town=梅田;ban=1;go=1;address_regime=unspecified"),
    ("大阪府堺市北区新金岡町1-1", 0, "prefecture=大阪府;city=堺市;ward=北区;lg_code=271462;town=新金岡町;ban=1;go=1;address_regime=unspecified"),
    ("神奈川県中区本町1-1", 0, "prefecture=神奈川県;city=横浜市;ward=中区;lg_code=141046;town=本町;ban=1;go=1;address_regime=unspecified"),
    ("泊村1-1", 2, "city=泊村;ban=1;go=1;address_regime=unspecified"),
    ("北海道国後郡泊村1-1", 0, "prefecture=北海道;county=国後郡;city=泊村;lg_code=016969;ban=1;go=1;address_regime=unspecified"),
    ("中京区寺町通御池上る上本能寺前町488", 0, "prefecture=京都府;city=京都市;ward=中京区;lg_code=261041;town=上本能寺前町;banchi=488;address_regime=chiban"),
    ("愛知郡東郷町", 0, "prefecture=愛知県;county=愛知郡;city=東郷町;lg_code=233021;address_regime=unspecified"),
    ("長野原町大字長野原1", 0, "prefecture=群馬県;county=吾妻郡;city=長野原町;lg_code=104248;town=大字長野原;oaza=長野原;banchi=1;address_regime=chiban"),
    ("大阪市北区梅田3-1-1", 0, "prefecture=大阪府;city=大阪市;ward=北区;lg_code=271276;town=梅田;chome=3;ban=1;go=1;address_regime=gaiku_hoshiki"),
    ("広島市中区基町10-52", 0, "prefecture=広島県;city=広島市;ward=中区;lg_code=341011;town=基町;ban=10;go=52;address_regime=unspecified"),
    ("福岡市博多区博多駅中央街1-1", 0, "prefecture=福岡県;city=福岡市;ward=博多区;lg_code=401323;town=博多駅中央街;ban=1;go=1;address_regime=unspecified"),
    ("神奈川区", 0, "prefecture=神奈川県;city=横浜市;ward=神奈川区;lg_code=141020;address_regime=unspecified"),
    ("宮城野区", 0, "prefecture=宮城県;city=仙台市;ward=宮城野区;lg_code=041025;address_regime=unspecified"),
    ("滋賀県愛知郡愛荘町愛知川1", 0, "prefecture=滋賀県;county=愛知郡;city=愛荘町;lg_code=254258;town=愛知川;ban=1;address_regime=unspecified"),
    ("愛知県愛知郡東郷町", 0, "prefecture=愛知県;county=愛知郡;city=東郷町;lg_code=233021;address_regime=unspecified"),
    ("西多摩郡日の出町平井2780", 0, "prefecture=東京都;county=西多摩郡;city=日の出町;lg_code=133051;town=平井;ban=2780;address_regime=unspecified"),
]
