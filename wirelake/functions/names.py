"""Names of protocol codes, as published by IANA and the protocols' standards."""

from __future__ import annotations

# Code -> name, in the wording users of capture tools query for.
DNS_TYPE = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC", 33: "SRV", 35: "NAPTR", 36: "KX",
    37: "CERT", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA",
    53: "SMIMEA", 55: "HIP", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 99: "SPF", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG",
    251: "IXFR", 252: "AXFR", 255: "ANY", 256: "URI", 257: "CAA", 32768: "TA", 32769: "DLV",
}
DNS_RCODE = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 11: "DSOTYPENI",
    16: "BADVERS", 17: "BADKEY", 18: "BADTIME", 19: "BADMODE", 20: "BADNAME", 21: "BADALG", 22: "BADTRUNC", 23: "BADCOOKIE",
}
DNS_CLASS = {1: "IN", 3: "CH", 4: "HS", 254: "NONE", 255: "ANY"}
ICMP_TYPE = {
    0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 6: "Alternate Host Address", 8: "Echo Request", 9: "Router Advertisement", 10: "Router Solicitation",
    11: "Time Exceeded", 12: "Parameter Problem", 13: "Timestamp", 14: "Timestamp Reply", 15: "Information Request", 16: "Information Reply", 17: "Address Mask Request", 18: "Address Mask Reply",
    30: "Traceroute", 32: "Mobile Host Redirect", 33: "IPv6 Where-Are-You", 34: "IPv6 I-Am-Here", 35: "Mobile Registration Request", 36: "Mobile Registration Reply", 37: "Domain Name Request",
    38: "Domain Name Reply", 39: "SKIP", 40: "Photuris", 41: "ICMP for Seamoby", 42: "Extended Echo Request", 43: "Extended Echo Reply",
}
ICMPV6_TYPE = {
    1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 4: "Parameter Problem", 100: "Private Experimentation", 101: "Private Experimentation", 127: "Reserved for Expansion",
    128: "Echo Request", 129: "Echo Reply", 130: "Multicast Listener Query", 131: "Multicast Listener Report", 132: "Multicast Listener Done", 133: "Router Solicitation", 134: "Router Advertisement",
    135: "Neighbor Solicitation", 136: "Neighbor Advertisement", 137: "Redirect", 138: "Router Renumbering", 139: "ICMP Node Information Query", 140: "ICMP Node Information Response",
    141: "Inverse Neighbor Discovery Solicitation", 142: "Inverse Neighbor Discovery Advertisement", 143: "MLDv2 Multicast Listener Report", 144: "Home Agent Address Discovery Request",
    145: "Home Agent Address Discovery Reply", 146: "Mobile Prefix Solicitation", 147: "Mobile Prefix Advertisement", 148: "Certification Path Solicitation", 149: "Certification Path Advertisement",
    150: "ICMP Experimental", 151: "Multicast Router Advertisement", 152: "Multicast Router Solicitation", 153: "Multicast Router Termination", 154: "FMIPv6", 155: "RPL Control",
    156: "ILNPv6 Locator Update", 157: "Duplicate Address Request", 158: "Duplicate Address Confirmation", 159: "MPL Control", 160: "Extended Echo Request", 161: "Extended Echo Reply",
    200: "Private Experimentation", 201: "Private Experimentation", 255: "Reserved for Expansion",
}
# type -> (code names, text before an unknown code)
ICMP_CODE = {
    3: ({
        0: "Network Unreachable", 1: "Host Unreachable", 2: "Protocol Unreachable", 3: "Port Unreachable", 4: "Fragmentation Needed", 5: "Source Route Failed", 6: "Destination Network Unknown",
        7: "Destination Host Unknown", 8: "Source Host Isolated", 9: "Network Administratively Prohibited", 10: "Host Administratively Prohibited", 11: "Network Unreachable for TOS",
        12: "Host Unreachable for TOS", 13: "Communication Administratively Prohibited", 14: "Host Precedence Violation", 15: "Precedence Cutoff in Effect",
    }, "Destination Unreachable"),
    5: ({0: "Redirect for Network", 1: "Redirect for Host", 2: "Redirect for TOS and Network", 3: "Redirect for TOS and Host"}, "Redirect"),
    11: ({0: "TTL Exceeded in Transit", 1: "Fragment Reassembly Time Exceeded"}, "Time Exceeded"),
    12: ({0: "Pointer Indicates Error", 1: "Missing Required Option", 2: "Bad Length"}, "Parameter Problem"),
}
ICMPV6_CODE = {
    1: ({
        0: "No Route to Destination", 1: "Administratively Prohibited", 2: "Beyond Scope of Source Address", 3: "Address Unreachable", 4: "Port Unreachable",
        5: "Source Address Failed Ingress/Egress Policy", 6: "Reject Route to Destination", 7: "Error in Source Routing Header",
    }, "Destination Unreachable"),
    3: ({0: "Hop Limit Exceeded in Transit", 1: "Fragment Reassembly Time Exceeded"}, "Time Exceeded"),
    4: ({0: "Erroneous Header Field", 1: "Unrecognized Next Header", 2: "Unrecognized IPv6 Option"}, "Parameter Problem"),
    138: ({0: "Router Renumbering Command", 1: "Router Renumbering Result", 255: "Sequence Number Reset"}, "Router Renumbering"),
    139: ({0: "NI Query for IPv6 Address", 1: "NI Query for Name or Empty", 2: "NI Query for IPv4 Address"}, "NI Query"),
    140: ({0: "NI Response Success", 1: "NI Responder Refuses", 2: "NI Unknown Query Type"}, "NI Response"),
}
IP_PROTO = dict(enumerate(
    "HOPOPT ICMP IGMP GGP IPv4 ST TCP CBT EGP IGP BBN-RCC-MON NVP-II PUP ARGUS EMCON XNET CHAOS UDP MUX DCN-MEAS HMP PRM XNS-IDP TRUNK-1 TRUNK-2 LEAF-1 LEAF-2 RDP IRTP ISO-TP4 NETBLT MFE-NSP "
    "MERIT-INP DCCP 3PC IDPR XTP DDP IDPR-CMTP TP++ IL IPv6 SDRP IPv6-Route IPv6-Frag IDRP RSVP GRE DSR BNA ESP AH I-NLSP SWIPE NARP MOBILE TLSP SKIP ICMPv6 IPv6-NoNxt IPv6-Opts".split()
)) | {
    62: "CFTP", 64: "SAT-EXPAK", 65: "KRYPTOLAN", 66: "RVD", 67: "IPPC", 69: "SAT-MON", 70: "VISA", 71: "IPCV", 72: "CPNX", 73: "CPHB", 74: "WSN", 75: "PVP", 76: "BR-SAT-MON", 77: "SUN-ND",
    78: "WB-MON", 79: "WB-EXPAK", 80: "ISO-IP", 81: "VMTP", 82: "SECURE-VMTP", 83: "VINES", 84: "TTP/IPTM", 85: "NSFNET-IGP", 86: "DGP", 87: "TCF", 88: "EIGRP", 89: "OSPF", 90: "Sprite-RPC",
    91: "LARP", 92: "MTP", 93: "AX.25", 94: "IPIP", 95: "MICP", 96: "SCC-SP", 97: "ETHERIP", 98: "ENCAP", 100: "GMTP", 101: "IFMP", 102: "PNNI", 103: "PIM", 104: "ARIS", 105: "SCPS", 106: "QNX",
    107: "A/N", 108: "IPComp", 109: "SNP", 110: "Compaq-Peer", 111: "IPX-in-IP", 112: "VRRP", 113: "PGM", 115: "L2TP", 116: "DDX", 117: "IATP", 118: "STP", 119: "SRP", 120: "UTI", 121: "SMP",
    122: "SM", 123: "PTP", 124: "ISIS", 125: "FIRE", 126: "CRTP", 127: "CRUDP", 128: "SSCOPMCE", 129: "IPLT", 130: "SPS", 131: "PIPE", 132: "SCTP", 133: "FC", 134: "RSVP-E2E-IGNORE",
    135: "Mobility", 136: "UDPLite", 137: "MPLS-in-IP", 138: "manet", 139: "HIP", 140: "Shim6", 141: "WESP", 142: "ROHC", 143: "Ethernet", 253: "Experimentation", 254: "Experimentation",
}
ETHERTYPE = {
    0x0800: "IPv4", 0x0806: "ARP", 0x0842: "Wake-on-LAN", 0x22EA: "SRP", 0x22F0: "AVTP", 0x22F3: "IETF TRILL", 0x6002: "DEC MOP RC", 0x6003: "DECnet", 0x6004: "DEC LAT", 0x8035: "RARP",
    0x809B: "AppleTalk", 0x80F3: "AARP", 0x8100: "VLAN", 0x8102: "SLPP", 0x8103: "VLACP", 0x8137: "IPX", 0x8204: "QNX Qnet", 0x86DD: "IPv6", 0x8808: "Flow Control", 0x8809: "LACP",
    0x8819: "CobraNet", 0x8847: "MPLS", 0x8848: "MPLS Multicast", 0x8863: "PPPoE Discovery", 0x8864: "PPPoE Session", 0x887B: "HomePlug 1.0 MME", 0x888E: "EAP over LAN", 0x8892: "PROFINET",
    0x889A: "HyperSCSI", 0x88A2: "ATA over Ethernet", 0x88A4: "EtherCAT", 0x88A8: "QinQ", 0x88AB: "Powerlink", 0x88B8: "GOOSE", 0x88B9: "GSE", 0x88BA: "SV", 0x88BF: "MikroTik RoMON",
    0x88CC: "LLDP", 0x88CD: "SERCOS III", 0x88DC: "WSMP", 0x88E1: "HomePlug AV MME", 0x88E3: "MRP", 0x88E5: "MACsec", 0x88E7: "PBB", 0x88F7: "PTP", 0x88F8: "NC-SI", 0x88FB: "PRP",
    0x8902: "CFM/OAM", 0x8906: "FCoE", 0x8914: "FCoE Init", 0x8915: "RoCE", 0x891D: "TTE", 0x892F: "HSR", 0x9000: "ECTP", 0x9100: "QinQ (old)", 0xCAFE: "Veritas LLT",
}
BGP_MESSAGE = {1: "OPEN", 2: "UPDATE", 3: "NOTIFICATION", 4: "KEEPALIVE", 5: "ROUTE-REFRESH"}
BGP_ORIGIN = {0: "IGP", 1: "EGP", 2: "INCOMPLETE"}
OSPF_PACKET = {1: "Hello", 2: "Database Description", 3: "Link State Request", 4: "Link State Update", 5: "Link State Acknowledgment"}
OSPF_LSA = {
    1: "Router-LSA", 2: "Network-LSA", 3: "Summary-LSA-Network", 4: "Summary-LSA-ASBR", 5: "AS-External-LSA", 6: "Group-Membership-LSA", 7: "NSSA-External-LSA", 8: "External-Attributes-LSA",
    9: "Opaque-Link-LSA", 10: "Opaque-Area-LSA", 11: "Opaque-AS-LSA",
}
GTP_MESSAGE = {
    1: "Echo Request", 2: "Echo Response", 3: "Version Not Supported", 16: "Create PDP Context Request", 17: "Create PDP Context Response", 18: "Update PDP Context Request",
    19: "Update PDP Context Response", 20: "Delete PDP Context Request", 21: "Delete PDP Context Response", 27: "PDU Notification Request", 28: "PDU Notification Response",
    31: "Supported Extension Headers Notification", 32: "Create Session Request", 33: "Create Session Response", 34: "Modify Bearer Request", 35: "Modify Bearer Response",
    36: "Delete Session Request", 37: "Delete Session Response", 38: "Change Notification Request", 39: "Change Notification Response", 64: "Modify Bearer Command",
    65: "Modify Bearer Failure Indication", 66: "Delete Bearer Command", 67: "Delete Bearer Failure Indication", 68: "Bearer Resource Command", 69: "Bearer Resource Failure Indication",
    70: "Downlink Data Notification Failure Indication", 95: "Create Bearer Request", 96: "Create Bearer Response", 97: "Update Bearer Request", 98: "Update Bearer Response",
    99: "Delete Bearer Request", 100: "Delete Bearer Response", 254: "End Marker", 255: "G-PDU",
}
NTP_MODE = {0: "Reserved", 1: "Symmetric Active", 2: "Symmetric Passive", 3: "Client", 4: "Server", 5: "Broadcast", 6: "NTP Control", 7: "Private"}
NTP_STRATUM = {0: "Unspecified", 1: "Primary Reference", 16: "Unsynchronized"}
TLS_VERSION = {0x0200: "SSL 2.0", 0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_RECORD = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData", 24: "Heartbeat"}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR", "NS")
