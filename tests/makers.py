"""A ferry with two receivers, and the sentences, logs and captures they leave behind."""

import math
import struct
from dataclasses import dataclass
from functools import reduce
from operator import xor
from pathlib import Path

from navspark.functions.geo import M_PER_DEG_LAT
from navspark.sources.pcap import RECEIVERS

KNOT = 1852 / 3600
SNRS = [33, 37, 40, 44, 47, 51]


def checked(body: str) -> str:
    return f"${body}*{reduce(xor, body.encode()):02X}"


def clock(seconds: float) -> str:
    hours, rest = divmod(seconds, 3600)
    return "%02d%02d%05.2f" % (hours, *divmod(rest, 60))


def degrees(value: float, digits: int, letters: str, minutes: int = 6) -> str:
    whole, part = divmod(abs(value), 1)
    return "%0*d%0*.*f,%s" % (digits, whole, minutes + 3, minutes, part * 60, letters[value < 0])


@dataclass
class Sighting:
    """Where and how a receiver is at a second of the day."""

    t: float
    lat: float = 54.32
    lon: float = 10.15
    knots: float = 11.0
    course: float = 300.0
    talker: str = "GP"

    @property
    def where(self) -> str:
        return degrees(self.lat, 2, "NS") + "," + degrees(self.lon, 3, "EW")

    def gga(self) -> str:
        return checked(f"{self.talker}GGA,{clock(self.t)},{self.where},1,06,1.4,18.2,M,44.1,M,,")

    def rmc(self) -> str:
        return checked(f"{self.talker}RMC,{clock(self.t)},A,{self.where},{self.knots:.1f},{self.course:.1f},070321,,,A")

    def vtg(self) -> str:
        return checked(f"{self.talker}VTG,{self.course:.1f},T,,M,{self.knots:.1f},N,{self.knots * 1.852:.1f},K,A")


DOP = checked("GPGSA,A,3,10,12,15,24,25,32,,,,,,,2.6,1.4,2.2")
_SKY = [f"{prn:02d},{12 + 9 * i:02d},{(47 * i) % 360:03d},{snr}" for i, (prn, snr) in enumerate(zip((10, 12, 15, 24, 25, 32), SNRS))]
IN_VIEW = [checked(f"GPGSV,2,{page + 1},06," + ",".join(_SKY[4 * page : 4 * page + 4])) for page in (0, 1)]


@dataclass
class Ferry:
    """Straight course; the second antenna stands abeam and slides outwards."""

    beam_m: float = 9.0
    slide_mps: float = 0.08
    knots: float = 11.0
    course: float = 300.0
    start: float = 5 * 3600 + 1800

    def at(self, t: float, receiver: int, talker: str = "GP") -> Sighting:
        run = self.knots * KNOT * (t - self.start)
        aside = (self.beam_m + self.slide_mps * (t - self.start)) if receiver == 2 else 0.0
        ahead, abeam = math.radians(self.course), math.radians(self.course + 90)
        north = run * math.cos(ahead) + aside * math.cos(abeam)
        east = run * math.sin(ahead) + aside * math.sin(abeam)
        lat = 54.32 + north / M_PER_DEG_LAT
        return Sighting(t, lat, 10.15 + east / (M_PER_DEG_LAT * math.cos(math.radians(lat))), self.knots, self.course, talker)

    def datagrams(self, seconds: int):
        for k in range(seconds):
            for (ip, port), receiver in RECEIVERS.items():
                s = self.at(self.start + k, receiver)
                for text in (s.gga(), *IN_VIEW, s.rmc(), DOP, s.vtg()):
                    yield datagram(text, ip, port)


def datagram(text: str, ip: str, port: int, link: str = "ethernet") -> bytes:
    """An IPv4/UDP packet behind the header of a link: ethernet, tagged (VLAN) or cooked (Linux any-device)."""
    udp = struct.pack(">4H", port, 4001, len(text) + 8, 0) + text.encode()
    address = lambda a: bytes(int(x) for x in a.split("."))
    ipv4 = struct.pack(">BxHxxxxBBxx", 0x45, len(udp) + 20, 32, 17) + address(ip) + address("10.1.1.1") + udp
    if link == "cooked":
        return struct.pack(">HHH8sH", 0, 1, 6, b"", 0x0800) + ipv4
    return bytes(12) + (b"\x81\x00\x00\x07" if link == "tagged" else b"") + b"\x08\x00" + ipv4 + b"pad"


def capture(packets, endian: str = "<", magic: int = 0xA1B2C3D4, link: int = 1) -> bytes:
    out = [struct.pack(endian + "IHHiIII", magic, 2, 4, 0, 0, 262144, link)]
    for n, packet in enumerate(packets):
        out += [struct.pack(endian + "4I", 1_615_000_000 + n, 0, len(packet), len(packet)), packet]
    return b"".join(out)


def capture_ng(packets, endian: str = "<", link: int = 1) -> bytes:
    """The same in pcapng: section header, interface, an enhanced packet block each, and a block to be skipped."""
    def block(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 4)
        return struct.pack(endian + "II", kind, len(body) + 12) + body + struct.pack(endian + "I", len(body) + 12)

    out = [block(0x0A0D0D0A, struct.pack(endian + "IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, struct.pack(endian + "HHI", link, 0, 0)), block(5, bytes(12))]
    out += [block(6, struct.pack(endian + "5I", 0, 0, n, len(p), len(p)) + p) for n, p in enumerate(packets)]
    return b"".join(out)


def save_lines(path, lines) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{line}\n" for line in lines))
