"""Process names that look like, but are not, well-known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Largest edit distance that still counts as look-alike.
DISTANCE = 3

#: Well-known process names; earlier ones win ties.
LEGITIMATE = [
    # core system
    "system", "smss.exe", "csrss.exe", "wininit.exe", "services.exe", "lsass.exe", "lsaiso.exe", "winlogon.exe",
    "svchost.exe",
    # user session
    "explorer.exe", "dwm.exe", "sihost.exe", "taskhostw.exe", "taskhost.exe", "ctfmon.exe", "conhost.exe",
    "fontdrvhost.exe", "runtimebroker.exe", "dllhost.exe", "rundll32.exe", "spoolsv.exe",
    # services
    "searchindexer.exe", "searchprotocolhost.exe", "searchfilterhost.exe", "wuauclt.exe", "trustedinstaller.exe",
    "tiworker.exe", "wudfhost.exe", "audiodg.exe", "winrshost.exe", "wmiprvse.exe", "msdtc.exe", "vssvc.exe",
    "msiexec.exe",
    # protection
    "msmpeng.exe", "msmpsvc.exe", "nissrv.exe", "securityhealthservice.exe", "securityhealthsystray.exe",
    "smartscreen.exe", "antimalwareservice.exe",
    # updates
    "usocoreworker.exe", "musnotification.exe", "musnotificationux.exe", "wuapp.exe",
    # shells and scripting
    "cmd.exe", "powershell.exe", "powershell_ise.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe",
    "reg.exe", "regedit.exe",
    # utilities
    "notepad.exe", "mspaint.exe", "calc.exe", "taskmgr.exe", "perfmon.exe", "resmon.exe", "mmc.exe", "eventvwr.exe",
    "diskpart.exe", "cleanmgr.exe", "dism.exe", "chkdsk.exe", "sfc.exe", "defrag.exe", "certutil.exe",
    "bitsadmin.exe", "sc.exe", "net.exe", "net1.exe", "netsh.exe", "whoami.exe", "hostname.exe", "ipconfig.exe",
    "ping.exe", "tracert.exe", "nslookup.exe",
    # office
    "outlook.exe", "winword.exe", "excel.exe", "powerpnt.exe", "onenote.exe", "mspub.exe", "msaccess.exe",
    "teams.exe", "lync.exe", "skype.exe", "onedrive.exe", "onedrivesetup.exe",
    # applications
    "notepad++.exe", "discord.exe", "zoom.exe", "spotify.exe", "steam.exe", "vlc.exe", "acrobat.exe", "acrord32.exe",
    "winrar.exe", "7zg.exe", "7zfm.exe",
    # drivers
    "nvcontainer.exe", "nvdisplay.container.exe", "amdrsserv.exe", "atieclxx.exe", "igfxem.exe", "igfxtray.exe",
    "realtekaudiosrv.exe",
    # virtual machines
    "vmware.exe", "vmware-vmx.exe", "vmwareuser.exe", "vmtoolsd.exe", "vboxservice.exe", "vboxtray.exe", "docker.exe",
    "dockerd.exe",
    # remote access
    "teamviewer.exe", "tvnserver.exe", "logmein.exe", "anydesk.exe", "rdpclip.exe", "mstsc.exe",
    # backup
    "backupclient.exe", "dropbox.exe", "googledrivesync.exe", "box.exe",
    # third-party protection
    "avgui.exe", "avastui.exe", "mbam.exe", "mbamservice.exe", "ccsvchst.exe", "nortonsecurity.exe", "mcuicnt.exe",
    "mcshield.exe", "eset.exe", "ekrn.exe",
    # development
    "git.exe", "java.exe", "javaw.exe", "devenv.exe",
    # printing
    "printfilterpipelinesvc.exe",
    # store applications
    "applicationframehost.exe", "systemsettings.exe", "calculator.exe", "windowsstore.exe", "yourphone.exe",
    "lockapp.exe",
]


def legitimate_names(spark) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(LEGITIMATE)], "legitimate string, ord int")


def look_alikes(names: DataFrame, name: str, known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Nearest known name of every distinct name that is not itself known.

    Names meet known names on equal lengths only: a name within ``distance``
    edits differs by at most that many characters, so each known name is listed
    under those lengths. The known side is broadcast after a size check.
    """
    distinct = names.select(F.lower(F.trim(F.col(name))).alias("name")).filter(F.col("name") != "").distinct()
    listed = known.select(
        "legitimate",
        "ord",
        F.explode(F.sequence(F.length("legitimate") - distance, F.length("legitimate") + distance)).alias("size"),
    )
    unknown = distinct.join(known.select(F.col("legitimate").alias("name")).distinct(), "name", "left_anti")
    pairs = unknown.withColumn("size", F.length("name")).join(listed, "size")
    near = pairs.withColumn("distance", F.levenshtein("name", "legitimate", distance)).filter(
        F.col("distance").between(1, distance)
    )
    best = near.groupBy("name").agg(F.min(F.struct("distance", "ord", "legitimate")).alias("best"))
    return best.select("name", F.col("best.legitimate").alias("legitimate"), F.col("best.distance").alias("distance"))
