"""The small labelled table that the personal-data tagger is trained from.

Invented sentences; ``[kind:text]`` marks a span. All addresses, numbers and
hosts are reserved for documentation or made up.
"""

from __future__ import annotations

EXAMPLES = """
Write to [email:anna.lee@example.com] before noon .
Contact: [email:j_smith99@mail.example.org], thanks
mail [email:bob+news@shop.example.net]
the address [email:kim at example dot com] works too
send it to [email:pat (at) example (dot) org] today
use [email:r.roe [at] post.example [dot] net] instead
please mail [email:team dot lead at example dot com]
or ask [email:info @ example.com] about it
[email:ann at mail dot example dot net] is the address
she answers at [email:joe at news dot example dot com] now
write to [email:desk [at] mail.example [dot] org] first
ask [email:board (at) club.example (dot) org] for more
[email:r_smith [at] example [dot] net] knows
[email:sales@example.co.uk] and [email:help@example.de] answer
Call [phone:+1 (743) 555-3824] after six
phone [phone:(555) 010-4477] or come by
ring [phone:555-010-9921] for details
our number is [phone:415-555-0132] all day
dial [phone:303-555-0164] until noon
it is [phone:617-555-0150] or [phone:617.555.0151]
tel: [phone:020 7946 0018] ext
my number is [phone:+44 20 7946 0958] .
call [phone:1-800-555-0199] now
Fax [phone:555.010.2231] and wait
phone: [phone:(212) 555 0147].
mobile [phone:+49 30 901820] bitte
tel [phone:0171 5550123] und [phone:0171 5550124]
from [ip:192.0.2.44] at night
host [ip:198.51.100.7] answered
server [ip:203.0.113.250]:8080 was down
the ip is [ip:10.0.0.12] .
login from [ip:172.16.254.1], twice
host [ip:192[.]0[.]2[.]61] is blocked
traffic from [ip:198 dot 51 dot 100 dot 23] again
ping [ip:203.0.113[.]9] please
server [ip:10 [dot] 1 [dot] 2 [dot] 3] answered
the address [ip:192 . 0 . 2 . 77] was used
card [card:4111 1111 1111 1111] was charged
paid by [card:5500-0000-0000-0004] yesterday
number [card:4012888888881881] expires
card no. [card:3782 822463 10005] please
visa [card:4222222222222] and cash
[card:6011 0009 9013 9424] is the card
version 2.0 of the license
released in 1998 and 2003 .
section 4.2.1 covers this
it costs 12.50 or 1,200 in total
the year 2024 had 366 days
pages 100-120 and 7-9
the ratio is 3.14159 to 1
on 2021-05-17 at 10:45 we met
at 5 dot we stopped
order 48213377 shipped in 3 days
call me at 5 or at 6
room 101 , floor 3
see chapter 12 , verse 7
the score was 3 - 2 at home
version 10.4.11.2 beta of the tool
the code 9f3a21c0 failed
id 20231105123456 in the log
isbn 978-3-16-148410-0 is a book
a total of 1 234 567 people
increase of 5 % in 10 years
user @ home and @ work
follow @ news for more
look at the dot on the map
meet at noon at the gate
and the of to in that it was
is at with from by for this
General Public License , version 3 .
CC BY-NC 4.0 applies
2 3 4 5 6 7 8 9
token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff
1 | 2 | 3 | 40 | 500
""".strip().split("\n")
