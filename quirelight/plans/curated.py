"""Dates of pages that no rule reads: raw text, date, and the remark where it is not the raw text itself."""

from __future__ import annotations

# What the raw dates of these pages stand for.
RENAISSANCE_COMPOSERS = """
died after 1436, fl. 1401–1420 = 1401 - 1436 =
fl. first half of the 15th century = 1400 - 1450
fl. late 15th – early 16th century = 1475 - 1525
fl. late 15th–early 16th century = 1475 - 1525
died 1512, fl. from 1478 = 1478 - 1512
1468 – 10 April 1548 = 1468 - 1548-04-10 =
born 1519?, fl. 1550–1570 = 1519 - 1570
died after 1561, fl. 1550 = 1550 - 1561
died 1581, fl. from c. 1567 = 1567 - 1581
died after 1570, fl. 1567 to 1570 = 1567 - 1570
died 1601, fl. from 1568 = 1568 - 1601
born 1565, fl. 1585 = 1565 - 1585
born c. 1566, fl. 1611 = 1566 - 1611
born c. 1573, fl. 1597 = 1573 - 1597
born 1577, fl. 1619 = 1577 - 1619
died 1629, fl. from 1599 = 1599 - 1629
1480 to 1488 – after 1558 = 1480 - 1558
c. 1495 – between 1527–33 = 1495 - 1533
c. 1500 – between 1550–60 = 1500 - 1550
c. 1500 to 1510 – 1561 = 1500 - 1561
c. 1520 to 1530 – 1597 = 1520 - 1597
c. 1530 – 1550-c. 1598 = 1530 - 1598
c. 1570 – between 1613–19 = 1570 - 1619
c. 1577 – between 1614–33 = 1577 - 1633 = c. 1577 - between 1614-33
? 1501 – 15?? = 1501
c. 1510 – 15?? = 1510
"""
MEDIEVAL_COMPOSERS = """
fl. c. 1129–c1150 = 1129 - 1150 = fl. c. 1129 – c. 1150
1140–1150 – c. 1190 = 1140 - 1190
c. 1145–1155 – 1204 = 1145 - 1204
fl. 2nd half of the 12th century = 1150 - 1200
c. 1150 – 30 August 1196 = 1150 - 1196-08-30
c. 1150–60 – c. 1200 = 1150 - 1200
c. 1150–60 – 1207 = 1150 - 1207
c. 1150–60 – 1231 = 1150 - 1231
c. 1160–1165 – after 1210 = 1160 - 1210
fl. 1185–1205 – c. 1205 = 1185 - 1205
fl. late 12th/early 13th century = 1175 - 1225
1200–10 – 1258/9 = 1200 - 1259 = 1200–1210 – 1258/1259
c. 1200 — before 1269 = 1200 - 1269
1245–50 – 1285–8/after 1306 = 1245 - 1306
fl. mid 13th-century = 1250
c. 1260 – 29 November 1318 = 1260 - 1318-11-29
fl. mid to late 13th-century = 1250 - 1275
c. 1320–1325 – 1362/1363 = 1320 - 1363
fl. 1350 fl. mid-14th century = 1350
fl. 2nd half of the fourteenth century = 1350 - 1400
fl. Late 14th century = 1375
2nd half of the 14th century = 1350 - 1400
c. 1350–1360 — after 1413 = 1350 - 1413
fl. 2nd half of the 14th century = 1350 - 1400
c. 1370–1385 – 1445 = 1370 - 1445
fl. mid-to-late 14th century = 1350 - 1375
fl. Early 15th century = 1400 - 1425
"""
BYZANTINE_COMPOSERS = """
fl. End of the 9th century = 875 - 900
fl. Late 13th century = 1275 - 1300
fl. first half of 15th century = 1400 - 1450
"""


def table(lines: str) -> dict[str, tuple[str, str]]:
    """The lines as raw text: (date, remark)."""
    found = {}
    for line in lines.strip("\n").split("\n"):
        raw, date, *remark = line.split(" =")
        found[raw] = (date.strip(), remark[0].strip() if remark else raw)
    return found
