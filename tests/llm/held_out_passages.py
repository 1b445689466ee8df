"""Passages written by hand that no training or calibration sees: (kind, 1 junk or 0 prose, lines that all carry the label)."""

HELD_OUT = [
    ("english", 0, "It took three days to find the missing volume, and when it was found the pages we needed had been cut out."),
    ("english", 0, "Nobody had warned the tenants. When the men came to read the meters, half of the doors stayed shut."),
    ("figures", 0, "Of 1,204 calls, 311 were about the new form, 98 about the old one, and the other 795 had nothing to do with either."),
    ("figures", 0, "The mean rose from 12.4 to 13.1 (s.e. 0.3), while the median stayed at 11.9, which suggests a few very large cases."),
    ("terse", 0, "shop shut, will be back monday\nowner ill, son runs it now\nasked him about the second meter, he knew nothing"),
    ("unpunctuated", 0, "we went along the canal as far as the lock and then turned back because the\npath was under water and the light was going and the dog would not walk\nany further whatever we said"),
    ("capitals", 0, "WE REGRET THAT THE COUNTER ON THE SECOND FLOOR CANNOT TAKE PAYMENTS UNTIL THE NEW MACHINE HAS ARRIVED."),
    ("dialogue", 0, "— And what did he say when you told him?\n— Nothing. He only looked at the clock.\n— Then he must have known."),
    ("questions", 0, "How many of them were still there in May? Did anyone count them? And if so, where is the list kept?"),
    ("wrapped", 0, "The bridge was closed for the\nwhole of the summer, and the\nfarmers had to bring the milk\nround by the northern road."),
    ("letter", 0, "Dear Mr Haas, I am sorry to say that we could not find your certificate. It may have been sent to your old address."),
    ("german", 0, "Als der Fluss über die Ufer trat, stand das Wasser im Keller des Amtes, und die alten Bücher schwammen zwischen den Regalen."),
    ("french", 0, "Quand on lui demanda pourquoi il était parti, il répondit qu'il n'avait jamais aimé le bruit de la ville."),
    ("spanish", 0, "Si el cartero no encuentra a nadie en casa, deja el paquete en la tienda de la esquina y avisa al día siguiente."),
    ("italian", 0, "La nebbia era così fitta che i pescatori non riuscivano a vedere la riva, e tornarono solo a mezzogiorno."),
    ("portuguese", 0, "Quando o rio transbordou, os moradores levaram os móveis para o andar de cima e esperaram que a água baixasse."),
    ("dutch", 0, "Omdat de brug kapot was, moesten de kinderen elke ochtend een half uur omlopen om op tijd op school te zijn."),
    ("swedish", 0, "När snön hade smält hittade de nycklarna under trappan, precis där hon hade letat hela vintern."),
    ("polish", 0, "Sąsiad obiecał, że naprawi płot przed zimą, ale potem zachorował i nikt już o tym nie pamiętał."),
    ("czech", 0, "Když se vrátili z pole, zjistili, že někdo otevřel okno a že po celé kuchyni běhají slepice."),
    ("russian", 0, "Он обещал вернуться до обеда, но дорогу размыло, и он добрался домой только на следующий день."),
    ("ukrainian", 0, "Ми довго чекали на автобус, а коли він нарешті приїхав, місць уже не було."),
    ("greek", 0, "Το χωριό ήταν άδειο τον χειμώνα, αλλά το καλοκαίρι γύριζαν όλοι και τα σπίτια γέμιζαν φωνές."),
    ("hungarian", 0, "A postás azt mondta, hogy a levél már egy hete megérkezett, csak senki sem ment el érte."),
    ("finnish", 0, "Kun jää suli, vene löytyi saaren takaa, mutta sen airot olivat kadonneet."),
    ("turkish", 0, "Köprü yıkılınca çocuklar okula gitmek için dağın öbür tarafından dolaşmak zorunda kaldılar."),
    ("chinese", 0, "我小时候住在河边，每年夏天都会发大水，大人们就把家具搬到楼上，等水退了再搬下来。"),
    ("japanese", 0, "祖父は毎朝早く起きて畑へ行き、昼になるまで帰ってこなかったが、雨の日だけは家で本を読んでいた。"),
    ("arabic", 0, "وصلت الرسالة متأخرة، ولم يعرف أحد من الذي أرسلها ولا لماذا فتحت قبل أن تصل إلينا."),
    ("hebrew", 0, "המכתב הגיע באיחור, ואיש לא ידע מי שלח אותו ולמה הוא נפתח לפני שהגיע אלינו."),
    ("damaged", 0, "The st0ve hod b~en out for tw0 days whcn tbe neighb0urs n0ticed that n0 sm0ke wos c0ming fr0m tho chimney."),
    ("mojibake", 0, "FÃ¼r die nÃ¤chste Sitzung brauchen wir noch zwei StÃ¼hle, weil der alte Tisch jetzt an der TÃ¼r steht."),
    ("tabs", 1, "oats\t12\t3.40\nrye\t9\t2.95\nbarley\t31\t4.10\nwheat\t7\t5.25"),
    ("caret", 1, "oats^12^north^a\nrye^9^south^b\nbarley^31^north^c\nwheat^7^east^a"),
    ("aligned", 1, "oats      12   north\nrye        9   south\nbarley    31   north\nwheat      7   east"),
    ("box", 1, "┌──────┬────┐\n│ oats │ 12 │\n├──────┼────┤\n│ rye  │  9 │\n└──────┴────┘"),
    ("yaml", 1, "fields:\n  - name: oats\n    size: 12\n  - name: rye\n    size: 9"),
    ("records", 1, "Crop: oats\nSize: 12\nSide: north\nCrop: rye\nSize: 9\nSide: south"),
    ("word table", 1, "oats sown north March dry\nrye sown south April wet\nbarley sown north March wet\nwheat sown east May dry"),
    ("arrows", 1, "→ oats (north)\n→ rye (south)\n→ barley (north)\n→ wheat (east)"),
    ("roman", 1, "i. oats\nii. rye\niii. barley\niv. wheat\nv. beans"),
    ("ingredients", 1, "200 g flour\n2 eggs\n1 pinch of salt\n80 g butter\n100 ml milk\n1 tsp sugar"),
    ("contents", 1, "I. The mill . . . . . . . 4\nII. The weir . . . . . . . 19\nIII. The owners . . . . . . 33"),
    ("names", 1, "Haas, Keller, Lindt, Moser, Nägeli, Oswald, Pfister, Rüegg, Suter, Tobler, Vogt, Weber, Zbinden"),
    ("glossary", 1, "weir — dam\nrace — channel\nstone — wheel\nhopper — feeder\nsluice — gate"),
    ("checklist", 1, "☐ stove off\n☑ windows shut\n☐ keys to the neighbour\n☑ water off"),
    ("syslog", 1, "May 03 04:12:55 mill7 cron[811]: session opened for user root\nMay 03 04:12:56 mill7 kernel: usb 1-2 reset by the host\nMay 03 04:13:02 mill7 sshd[97]: connection closed by 10.1.1.9"),
    ("plain log", 1, "INFO server connection from alpha closed after 12 ms\nINFO server connection from beta closed after 31 ms\nWARN queue of the worker is full, waiting for 5 s\nINFO worker of the queue started in 8 ms"),
    ("access log", 1, "10.1.1.9 - - [03/May/2011] \"GET /mill/race.html HTTP/1.1\" 200 5120\n10.1.1.4 - - [03/May/2011] \"GET /mill/weir.html HTTP/1.1\" 404 310"),
    ("breadcrumb", 1, "Start › Crops › Cereals › Oats › Prices › 2011"),
    ("footer", 1, "About us · Terms · Privacy · Cookies · Jobs · Press · Contact · © 2011"),
    ("tags", 1, "#mill #weir #oats #harvest #north #autumn #bread #river"),
    ("urls", 1, "https://mill.example/race?id=9\nhttps://mill.example/weir?id=12\nftp://mill.example/pub/oats.zip"),
    ("css", 1, ".mill { color: #333; margin: 0 auto; }\n.weir > a:hover { border: 1px solid; }"),
    ("java", 1, "public int weir(int a) {\n    if (a < 0) return -a;\n    return race.get(a) + 1;\n}"),
    ("hex", 1, "4d 69 6c 6c 00 1f 8b 08 00 ff e1 3c\n7a 11 90 04 d2 45 5e 6b 00 00 12 fe"),
    ("uuid", 1, "9f1c2e4a-11d0-4c3b-9b7e-2f00aa91c7d2 77ab10c2-90fe-4d11-8a53-0c9d1e55b1a0"),
    ("shuffled", 1, "chimney days neighbours that the been for no out two was stove noticed when from coming had the smoke the"),
    ("shuffled with stop", 1, "Bridge the for whole closed was and the summer of northern the farmers milk round had road bring by to."),
    ("linking words", 1, "the of and a to for in that the is of with and on the to by of the at"),
    ("keywords", 1, "mill weir race oats flour bread stone wheel river autumn harvest north price market cart horse"),
    ("keywords with stop", 1, "Mill weir race oats flour bread stone wheel river autumn harvest north price market cart horse."),
    ("joined words", 1, "thestovehadbeenoutfortwodayswhentheneighboursnoticed thatnosmokewascomingfromthechimney"),
    ("gibberish", 1, "lorv brix tembul oranq zif dweel marnop quist blenk favor trim sool grent wibb"),
    ("consonants", 1, "wrtk plmq zzvd\nkkjhg rrtp\nbvcx nmlk qwrt\npp dfgh"),
    ("symbols", 1, "◆◇◆ ★☆★ ►► ◄◄ ●○● ♦♦ ▲▼▲ ■□■ ◆◇◆"),
    ("rulers", 1, "=====================\n---------------------\n*********************"),
    ("broken", 1, "ï»¿Ã¢â‚¬Å“ Ã‚Â Ã¯Â¿Â½ Ãƒâ€šÃ‚ Â¤Â¶ Ã¢â‚¬ Ã‚Â±"),
    ("repeated", 1, "error error error error error error error error error error error error"),
    ("score", 1, "E4 G4 A4 B4 E5 D5 B4 A4 G4 E4 D4 E4"),
    ("timetable", 1, "06:12 06:42 07:12 07:42 08:12\n06:31 07:01 07:31 08:01 08:31\n06:55 07:25 07:55 08:25 08:55"),
    ("codes", 1, "ZX81 QL-2 PC1512 C64 VC20 MZ-80K TI99/4A"),
    ("chinese list", 1, "苹果、香蕉、梨\n12 斤、9 斤、31 斤\n红、黄、绿"),
    ("russian list", 1, "- овёс\n- рожь\n- ячмень\n- пшеница"),
    ("german list", 1, "• Hafer, zwei Säcke\n• Roggen\n• Gerste, ein Sack\n• Weizen vom Nachbarn"),
]
