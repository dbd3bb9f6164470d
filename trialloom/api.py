"""The public names in one place."""

from trialloom.functions.kernels import TrialKernel, register
from trialloom.model import Trials, analog_from_arrays, concat_trials, copy, make
from trialloom.operators.arithmetic import concat, equal
from trialloom.operators.connectivity import connectivityanalysis
from trialloom.operators.drift import canonical_fields, field_changes, typed_table
from trialloom.operators.intervals import cover_and_gaps
from trialloom.operators.plots import lines, panels, raster
from trialloom.operators.preprocess import nan_trials, preprocessing, resampledata
from trialloom.operators.selection import best_match, selectdata, show
from trialloom.operators.spectral import freqanalysis
from trialloom.operators.spikes import SpikeRule, suspect_readings
from trialloom.operators.statistics import itc, mean, median, spike_psth, std, timelockanalysis, var
from trialloom.operators.trials import definetrial, redefinetrial
from trialloom.sources import synthetic
from trialloom.sources.container import cleanup, clear, load, save
from trialloom.sources.foreign import from_mne_epochs, from_mne_raw, load_mat, load_nwb, save_nwb, to_mne_epochs, to_mne_raw
from trialloom.sources.raw import block_index, block_info, load_block, load_foreign, load_raw, register_reader

__all__ = [name for name in dir() if not name.startswith("_")]
