"""Passages written and checked by hand, to calibrate scores: (1 junk or 0 prose, lines that all carry the label)."""

CHECKED = [
    (0, "The letter had been opened before it reached us, so we asked the post office for a statement.\nThey answered within a week."),
    (0, "called twice, no answer\nleft a note with the neighbour, who says they moved in spring\nwill try again on friday"),
    (0, "Of the 412 forms, 18 came back empty and 7 had been filled in by the wrong person, which is 6 per cent in all."),
    (0, "when the roof was repaired the clerk moved the files to the cellar and nobody\nthought of telling the people who came to ask for them so for two months\nthe answer was always that the file did not exist"),
    (0, "THE OFFICE WILL BE CLOSED ON MONDAY BECAUSE THE HEATING HAS FAILED AGAIN. PLEASE USE THE SIDE ENTRANCE."),
    (0, "Why was the second count lower than the first? Because two streets were left out, and no one had noticed."),
    (0, "Anna: I thought you had sent it.\nPeter: No, I was waiting for your signature.\nAnna: Then it is still on my desk."),
    (0, "> I don't think we can accept this version, the totals on page two don't match.\n> Could you look at it before the meeting?"),
    (0, "Nach dem Umbau wurden die Akten in den zweiten Stock gebracht, wo sie bis heute liegen.\nNiemand hat sie seither vermisst."),
    (0, "Die Zahl der Anträge stieg von 311 auf 420, obwohl die Frist um zwei Wochen verkürzt worden war."),
    (0, "Le bureau ferme à cinq heures, mais il arrive que le gardien laisse entrer ceux qui viennent de loin."),
    (0, "Nous avons compté deux fois les mêmes maisons, parce que la rue avait changé de nom entre-temps."),
    (0, "El archivo llegó incompleto y tuvimos que pedir las hojas que faltaban a la oficina del condado."),
    (0, "Nel registro mancavano tre nomi, e nessuno sapeva dire se fossero partiti o se li avessero dimenticati."),
    (0, "A carta chegou com um mês de atraso, quando a família já se tinha mudado para outra cidade."),
    (0, "De man aan het loket zei dat het formulier nog niet was verwerkt en dat we volgende week terug moesten komen."),
    (0, "Vi fick vänta länge på svaret, och när det kom var det ställt till fel person."),
    (0, "Urzędnik sprawdził adres jeszcze raz, ale w księdze nie było nikogo o tym nazwisku."),
    (0, "Письмо вернули отправителю, потому что дом по этому адресу был снесён ещё прошлой осенью."),
    (0, "Η επιστολή έφτασε αργά και κανείς δεν ήξερε ποιος την είχε στείλει."),
    (0, "办公室搬到了三楼，可是门口的牌子还没有换，所以很多人走错了地方。"),
    (0, "窓口の人は、書類がまだ届いていないので来週もう一度来てほしいと言った。"),
    (0, "Virkailija sanoi, että hakemus oli hukkunut muuton aikana ja että se pitäisi täyttää uudelleen."),
    (0, "Memur, dosyanın henüz gelmediğini ve gelecek hafta tekrar uğramamız gerektiğini söyledi."),
    (0, "LÃ¶sningen var enkel, men ingen hade tÃ¤nkt pÃ¥ att frÃ¥ga grannen fÃ¶rst."),
    (0, "Tbe cl~rk sa1d tbat tho registcr hod been c1osed at tbe end of tho montb, ond tbat n0body c0uld open it."),
    (0, "Dear all, thanks for your notes; I have put them in the draft, apart from the one on page 9, which I did not understand."),
    (0, "In 1998 there were 61 births, in 1999 there were 58, and in 2000, when the clinic had closed, only 12."),
    (0, "nobody knows why the west wing reports ten days later than everyone else but it has been so for years"),
    (1, "Name        Born        Parish\nAdler       1871        Nordby\nBrandt      1869        Sund\nCohn        1902        Vik"),
    (1, "id,parish,born,died\n17,Nordby,1871,1903\n18,Sund,1869,1911\n19,Vik,1902,\n20,Nordby,1888,1931"),
    (1, "|year|births|deaths|\n|1901|44|31|\n|1902|39|36|\n|1903|41|28|"),
    (1, "- blue ink, two bottles\n- stamps\n- envelopes, large\n- string\n- red tape"),
    (1, "1. Adler\n2. Brandt\n3. Cohn\n4. Dahl\n5. Eriksen"),
    (1, "Contents\nPreface 3\nThe old parishes 7\nSources and their faults 15\nTables 41\nIndex 90"),
    (1, "Home | News | Contact | Imprint | Log in | Register | Search | Help"),
    (1, "10:02:11 INFO server connection from 10.0.0.7 closed after 12 ms\n10:02:13 WARN server no answer from the queue, retry 3\n10:02:19 INFO worker started with 4 threads in the pool"),
    (1, "Traceback (most recent call last):\n  File \"run.py\", line 81, in main\n    load(path, mode=2)\nValueError: bad header in block 17"),
    (1, "for i in range(10):\n    total += rows[i].get('n', 0)\nprint(total)"),
    (1, "{\"parish\": \"Vik\", \"rows\": [1, 5, 8], \"ok\": true}, {\"parish\": \"Sund\", \"rows\": [2, 9], \"ok\": false}"),
    (1, "<ul><li>Adler</li><li>Brandt</li><li>Cohn</li></ul>\n<p class=\"x\"></p><br/><hr/>"),
    (1, "QmFzZSA2NCBpcyBub3QgdGV4dCBidXQgaXQgaXMgb2Z0ZW4gZm91bmQgaW4gbWFpbHMgYW5kIGxvZ3M="),
    (1, "the of and to in the a of that with for on and the by to of in"),
    (1, "letter the opened us had so office before we reached it been statement a for asked the post"),
    (1, "ink stamp envelope register cohort parish index letter clerk ledger volume page shelf box drawer"),
    (1, "archive archive archive archive copy copy archive archive copy archive copy copy archive"),
    (1, "xqzt brmf ghlk wpty nnsd vvbx kkrt plmn qqws zzxc trrf hhjk"),
    (1, "~~^^|| ..;;:: ## %% @@ ~~ -- == ++ ^^ ~~ || ;; ::"),
    (1, "Ã©Ã¨â€™Â Ã Ã§Ã´ ï¿½ï¿½ Ã©â€œ Â»Â« ï¿½Ã¯ Ã»Ã¹ â€"),
    (1, "A-17/3 B-18/9 C-02/4 D-77/1 E-10/5 F-31/2"),
    (1, "theletterhadbeenopenedbeforeitreachedusandnobodyknewwhyithappened"),
    (1, "name=Adler born=1871 parish=Nordby\nname=Brandt born=1869 parish=Sund\nname=Cohn born=1902 parish=Vik"),
    (1, "Monday: closed\nTuesday: 9-12\nWednesday: 9-12, 14-16\nThursday: 9-12\nFriday: 9-11"),
    (1, "Adler, Nordby; Brandt, Sund; Cohn, Vik; Dahl, Nordby; Eriksen, Sund; Falk, Vik; Grieg, Nordby"),
    (1, "from the clerk: ledger of Vik\nfor the parish: index of Sund\nto the board: letter of Nordby\nfrom the board: box of Vik"),
    (1, "SELECT parish, count(*) FROM births WHERE year > 1900 GROUP BY parish;\nDROP TABLE IF EXISTS tmp_births;"),
    (1, "姓名 年龄 教区\n王 41 北\n李 37 南\n张 58 东"),
    (1, "Адлер; 1871; Нордби\nБрандт; 1869; Сунд\nКон; 1902; Вик"),
]
